"""Vote and review summaries (survey S11, W2, A17-A21)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineweave.functions.expressions import wilson
from lineweave.operators.catalog import first_per_key

VOTES = "timestamp string, trial_id string, query_segment_id string, run_id string, winner_backend string, tie boolean, both_poor boolean"
REVIEWS = "timestamp string, space string, k int, token string, rating string"
TRIALS = "timestamp string, trial_id string, space string, k int, same_cluster_won boolean, tie boolean, neither boolean"


def earliest(rows: DataFrame, keys: list[str], time: str, ordinal: str) -> DataFrame:
    """The first vote per key; equal times by order of arrival."""
    return first_per_key(rows, keys, [F.col(time), F.col(ordinal)])


def status(passes: Column, fails: Column) -> Column:
    return F.when(passes, "pass").when(fails, "fail").otherwise("inconclusive")


#: The counts that a summary of votes is made of; counts of parts add up.
COUNTS = ["votes", "wins", "losses", "ties", "both_poor"]


def partial_counts(votes: DataFrame, by: list[str], times: Column | None = None) -> DataFrame:
    """COUNTS by group over votes (won, tie, both_poor), each vote counting `times`."""
    tie, poor, won = (F.coalesce(c, F.lit(False)) for c in ("tie", "both_poor", "won"))
    one = F.lit(1) if times is None else times
    of = lambda which: F.coalesce(F.sum(F.when(which, one.cast("long"))), F.lit(0))
    kinds = [F.lit(True), ~tie & ~poor & won, ~tie & ~poor & ~won, tie, poor]
    return votes.groupBy(*by).agg(*[of(which).alias(c) for c, which in zip(COUNTS, kinds, strict=True)])


def vote_summary(votes: DataFrame, by: list[str] | None = None, least: int = 50) -> DataFrame:
    """Per group of earliest votes: wins, losses, ties, both_poor, decisive, share of wins, interval, status.

    votes: won (boolean), tie, both_poor. Without votes and groups the one row holds zeros and is inconclusive.
    """
    return summarised(partial_counts(votes, by or []), least)


def summarised(n: DataFrame, least: int = 50) -> DataFrame:
    """COUNTS by group with decisive votes, share of wins, interval and status."""
    n = n.withColumn("decisive", F.col("wins") + F.col("losses"))
    low, high = wilson(F.col("wins"), F.col("decisive"))
    n = n.withColumn("win_share", F.when(F.col("decisive") > 0, F.col("wins") / F.col("decisive")).otherwise(0.0)).withColumn("low", low).withColumn("high", high)
    return n.withColumn("status", status((F.col("decisive") >= least) & (F.col("low") > 0.5), (F.col("decisive") >= least) & (F.col("high") < 0.5)))


def review_summary(reviews: DataFrame, good: str = "coherent", least: int = 40, passing: float = 0.65, failing: float = 0.40) -> DataFrame:
    """One row over the earliest review of each token: reviewed, coherent, share, status."""
    n = reviews.agg(F.count(F.lit(1)).alias("reviewed"), F.count_if(F.col("rating") == good).alias("coherent"))
    n = n.withColumn("share", F.when(F.col("reviewed") > 0, F.col("coherent") / F.col("reviewed")).otherwise(0.0))
    return n.withColumn("status", status((F.col("reviewed") >= least) & (F.col("share") >= passing), (F.col("reviewed") >= least) & (F.col("share") < failing)))


def trial_summary(trials: DataFrame, least: int = 50) -> DataFrame:
    """One row over the earliest entry of each trial: decisive, same-cluster and different-cluster wins, status."""
    clear = ~F.coalesce("tie", F.lit(False)) & ~F.coalesce("neither", F.lit(False))
    n = trials.agg(F.count(F.lit(1)).alias("trials"), F.count_if(clear).alias("decisive"), F.count_if(clear & F.coalesce("same_cluster_won", F.lit(False))).alias("same"))
    n = n.withColumn("different", F.greatest(F.lit(0), F.col("decisive") - F.col("same")))
    low, high = wilson(F.col("same"), F.col("decisive"))
    n = n.withColumn("low", low).withColumn("high", high)
    return n.withColumn("status", status((F.col("decisive") >= least) & (F.col("low") > 0.5), (F.col("decisive") >= least) & (F.col("high") < 0.5)))


def combined_status(reviews: DataFrame, trials: DataFrame) -> DataFrame:
    """Pass if both pass, fail if either fails; both inputs are one row."""
    both = reviews.select(F.col("status").alias("reviews")).join(F.broadcast(trials.select(F.col("status").alias("trials"))))
    return both.withColumn("status", status((F.col("reviews") == "pass") & (F.col("trials") == "pass"), (F.col("reviews") == "fail") | (F.col("trials") == "fail")))
