"""Statistics of clusterings, tokens and segments (survey A3-A9, A14-A16, A23-A26, W7, W11, V10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.functions.expressions import entropy
from lineweave.operators.ranks import quantiles_of, ranked


def histogram(rows: DataFrame, value: Column, bins: int) -> DataFrame:
    """(bin, n) over equal bins from least to largest value, the last one closed; one bin if all are equal."""
    v = rows.select(value.cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    ends = v.agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    at = F.when(F.col("_hi") > F.col("_lo"), F.least(F.lit(bins - 1), F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins))).otherwise(0)
    return v.join(F.broadcast(ends)).select(at.cast("int").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))  # ends is one row


def cluster_stats(assigned: DataFrame, cluster: str = "cluster_id", token: str = "token", cosine: str = "cosine", margin: str = "margin") -> DataFrame:
    """A5: per cluster its token, size, mean, median and tenth percentile of the cosine, mean and median margin."""
    means = assigned.groupBy(cluster).agg(F.min(token).alias("token"), F.count(F.lit(1)).alias("size"), F.avg(cosine).alias("mean_cosine"), F.avg(margin).alias("mean_margin"))
    marks = quantiles_of(assigned, {cosine: {"median_cosine": 0.5, "p10_cosine": 0.1}, margin: {"median_margin": 0.5}}, [cluster])
    return means.join(marks, cluster, "left").select(cluster, "token", "size", "mean_cosine", "median_cosine", "p10_cosine", "mean_margin", "median_margin")


def occupancy(assigned: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """One row: sizes of clusters, shares of small ones, and the mass in the largest 1, 5 and 10 percent."""
    size = assigned.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"))
    k = size.agg(F.count(F.lit(1)).alias("k"), F.sum("size").alias("total"))
    placed = ranked(size, [F.desc("size"), F.col(cluster)]).withColumn("rank", F.col("rank") + 1).join(F.broadcast(k))  # k is one row
    mass = lambda share: F.sum(F.when(F.col("rank") <= F.greatest(F.lit(1), F.ceil(F.col("k") * share)), F.col("size")).otherwise(0)) / F.max("total")
    return placed.agg(
        F.min("size").alias("least"), F.median("size").alias("median"), F.avg("size").alias("mean"), F.max("size").alias("most"),
        *[F.percentile("size", F.lit(q)).alias(f"q{int(q * 100):02d}") for q in (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)],  # over clusters
        *[F.avg((F.col("size") < n).cast("double")).alias(f"below_{n}") for n in (5, 10, 25)],
        *[mass(p).alias(f"mass_{int(p * 100)}") for p in (0.01, 0.05, 0.1)],
    )


def cohesion(assigned: DataFrame, cosine: str = "cosine", margin: str = "margin") -> DataFrame:
    """Mean, median and quantiles of cosine and margin, and the mean quantisation error 1 - cosine."""
    means = assigned.agg(F.avg(cosine).alias("mean_cosine"), F.avg(margin).alias("mean_margin"), F.avg(1 - F.col(cosine)).alias("quantization_error"))
    marks = quantiles_of(assigned, {cosine: {"median_cosine": 0.5, "q10_cosine": 0.1, "q90_cosine": 0.9}, margin: {"median_margin": 0.5}})
    both = means.join(F.broadcast(marks))  # one row each
    return both.select("mean_cosine", "median_cosine", "q10_cosine", "q90_cosine", "mean_margin", "median_margin", "quantization_error")


def effective_vocabulary(rows: DataFrame, token: str, nominal: int | None = None) -> DataFrame:
    """Entropy of the tokens, its exponential, and that over the observed (and the nominal) number of tokens."""
    counts = rows.where(F.col(token).isNotNull()).groupBy(token).agg(F.count(F.lit(1)).alias("n"))
    h = counts.join(F.broadcast(counts.agg(F.sum("n").alias("total")))).agg(F.coalesce(F.sum(entropy(F.col("n"), F.col("total"))), F.lit(0.0)).alias("entropy"), F.count(F.lit(1)).alias("observed"))
    out = h.select("entropy", "observed", F.exp("entropy").alias("effective"), (F.exp("entropy") / F.greatest(F.lit(1), F.col("observed"))).alias("effective_fraction"))
    return out if nominal is None else out.withColumn("nominal_fraction", F.col("effective") / float(nominal))


def joint_stats(rows: DataFrame, a: str, b: str, top: int = 20) -> dict[str, DataFrame]:
    """Entropies of two token columns and of their pairs, mutual information; the most frequent pairs; diversity."""
    pairs = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    total = F.broadcast(pairs.agg(F.sum("n").alias("total")))

    def h(counts: DataFrame, name: str) -> DataFrame:
        return counts.join(total).agg(F.coalesce(F.sum(entropy(F.col("n"), F.col("total"))), F.lit(0.0)).alias(name), F.count(F.lit(1)).alias(f"{name}_kinds"))

    each = [h(pairs, "joint"), h(pairs.groupBy(a).agg(F.sum("n").alias("n")), "first"), h(pairs.groupBy(b).agg(F.sum("n").alias("n")), "second")]
    summary = each[0].join(F.broadcast(each[1])).join(F.broadcast(each[2])).withColumn("information", F.col("first") + F.col("second") - F.col("joint"))
    return {
        "summary": summary,
        "top_pairs": pairs.orderBy(F.desc("n"), a, b).limit(top),
        "first_diversity": pairs.groupBy(a).agg(F.count(F.lit(1)).alias("kinds")).orderBy(F.desc("kinds"), a).limit(top),
        "second_diversity": pairs.groupBy(b).agg(F.count(F.lit(1)).alias("kinds")).orderBy(F.desc("kinds"), b).limit(top),
    }


def agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index and normalised mutual information (arithmetic mean) of two labellings; one row.

    Both are 1 for labellings equal up to names; rows with a null label don't count.
    """
    cells = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    choose = lambda c: c * (c - 1) / 2.0
    n = F.col("n").cast("double")

    def of(counts: DataFrame, name: str) -> DataFrame:
        return counts.agg(F.sum(choose(n)).alias(f"c_{name}"), F.sum(n * F.ln(n)).alias(f"l_{name}"), F.sum(n).alias(f"n_{name}"))

    row = of(cells, "ab").join(F.broadcast(of(cells.groupBy(a).agg(F.sum("n").alias("n")), "a"))).join(F.broadcast(of(cells.groupBy(b).agg(F.sum("n").alias("n")), "b")))
    total = F.col("n_ab")
    h = lambda name: F.ln(total) - F.col(f"l_{name}") / total
    expected = F.col("c_a") * F.col("c_b") / F.greatest(choose(total), F.lit(1.0))
    most = (F.col("c_a") + F.col("c_b")) / 2
    mutual, mean = h("a") + h("b") - h("ab"), (h("a") + h("b")) / 2
    return row.select(
        F.when(F.abs(most - expected) < 1e-12, 1.0).otherwise((F.col("c_ab") - expected) / (most - expected)).alias("ari"),
        F.when(mean < 1e-12, 1.0).otherwise(F.greatest(F.lit(0.0), mutual) / mean).alias("nmi"),
    )


def concentration(rows: DataFrame, token: str, score: str, composer: str) -> DataFrame:
    """Per token its count, distinct scores and composers, the largest share of one of each, and a flag.

    Nulls count neither for a share nor for its base; a token with nothing but nulls has share 0.
    """
    kinds = rows.select(F.col(token).alias("token"), F.explode(F.array(F.struct(F.lit("s").alias("k"), F.col(score).cast("string").alias("v")), F.struct(F.lit("c").alias("k"), F.col(composer).cast("string").alias("v")))).alias("e"))
    n = kinds.groupBy("token", "e.k", "e.v").agg(F.count(F.lit(1)).alias("n"))
    share = lambda k: F.coalesce(F.max(F.when((F.col("k") == k) & F.col("v").isNotNull(), F.col("n"))) / F.sum(F.when((F.col("k") == k) & F.col("v").isNotNull(), F.col("n"))), F.lit(0.0))
    out = n.groupBy("token").agg(
        F.sum(F.when(F.col("k") == "s", F.col("n"))).alias("n"), F.count_if((F.col("k") == "s") & F.col("v").isNotNull()).alias("scores"),
        F.count_if((F.col("k") == "c") & F.col("v").isNotNull()).alias("composers"), share("s").alias("score_share"), share("c").alias("composer_share"),
    )
    return out.withColumn("flagged", (F.col("score_share") >= 0.5) | (F.col("composer_share") >= 0.5))


def multi_resolution(coarse: DataFrame, fine: DataFrame, key: str, parent: str, child: str) -> DataFrame:
    """How clusters of one codebook fall into those of the next: overlap and its share of both."""
    n = coarse.select(key, parent).join(fine.select(key, child), key).groupBy(parent, child).agg(F.count(F.lit(1)).alias("overlap"))
    share = lambda c: F.col("overlap") / F.sum("overlap").over(Window.partitionBy(c))
    return n.select(parent, child, "overlap", share(parent).alias("of_parent"), share(child).alias("of_child"))


def compared(codebooks: DataFrame, size: str, error: str) -> DataFrame:
    """One row per codebook, the one with the least error marked (ties: the smaller size)."""
    best = codebooks.agg(F.min_by(size, F.struct(error, size)).alias("_best"))
    return codebooks.join(F.broadcast(best)).withColumn("best", F.col(size) == F.col("_best")).drop("_best")
