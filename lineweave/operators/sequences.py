"""Token sequences: ordered collection, n-grams, transition probabilities (survey A10-A13, J2, W7, W4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineweave.operators.ranks import quantiles


def collected(rows: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """One row per key (a null key is one too) with parallel arrays of the columns in the given order."""
    packed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, *[F.col(c).alias(f"_{c}") for c in columns]))).alias("_rows"))
    return packed.select(*keys, F.size("_rows").alias("sequence_length"), *[F.col("_rows").getField(f"_{c}").alias(f"{c}s") for c in columns])


def ngrams(rows: DataFrame, keys: list[str], order: list[str], token: str, n: int) -> DataFrame:
    """(t1, ..., tn, n): counts of n tokens in a row, never across sequences; null tokens break none and count."""
    w = Window.partitionBy(*keys).orderBy(*order)
    names = [f"t{i + 1}" for i in range(n)]
    spread = rows.select(F.col(token).alias("t1"), *[F.lead(token, i).over(w).alias(f"t{i + 1}") for i in range(1, n)], F.lead(F.lit(1), n - 1).over(w).alias("_full") if n > 1 else F.lit(1).alias("_full"))
    return spread.where("_full = 1").groupBy(*names).agg(F.count(F.lit(1)).alias("n"))


def transitions(bigrams: DataFrame) -> DataFrame:
    """The share of each second token after a first one."""
    return bigrams.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("t1")))


def length_stats(sequences: DataFrame, size: str = "sequence_length") -> DataFrame:
    """A10: number of sequences, median and quantiles of their lengths."""
    total = sequences.agg(F.count(F.lit(1)).alias("sequences"))
    return total.join(F.broadcast(quantiles(sequences, size, {"median": 0.5, "q10": 0.1, "q50": 0.5, "q90": 0.9})))  # one row each


def exported(melody: DataFrame, rhythm: DataFrame, combined: DataFrame, about: DataFrame, key: str) -> DataFrame:
    """Melody and rhythm tokens of a segment with its description and, where there is one, combined token."""
    m = melody.select(key, F.col("token").alias("melody_token"))
    r = rhythm.select(key, F.col("token").alias("rhythm_token"))
    c = combined.select(key, F.col("token").alias("combined_token"))
    return m.join(r, key).join(about, key, "left").join(c, key, "left")


def top_tokens(rows: DataFrame, token: str, value: str, n: int) -> DataFrame:
    """U4: the n distinct tokens whose best rows have the largest values; ties by token."""
    return rows.groupBy(token).agg(F.max(value).alias("top")).orderBy(F.desc("top"), token).limit(n)
