"""Scaling, projection and collapse of vectors from one pass of mergeable sums (survey V2f, V2g, K7, V23).

A task adds up the products of its vectors' components, each vector with a 1 at its end; the sums of all tasks add up
to the number of rows, their mean and their covariance, whatever the rows' order. All that reaches the driver is one
matrix of the vectors' length. What is fitted is saved as a table and a manifest, and applied to rows and streams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineweave.functions.expressions import dot, hash_order, unit
from lineweave.operators.ann import usable
from lineweave.operators.ranks import quantiles, ranked
from lineweave.sources import tables
from lineweave.sources.scratch import written

#: Rows of one block in which each meets the one before it.
BLOCK = 4096


@dataclass(frozen=True)
class Moments:
    """Number, mean and population covariance of vectors."""

    n: int
    mean: np.ndarray
    covariance: np.ndarray


def moments(rows: DataFrame, vector: str) -> Moments:
    """Of all vectors that aren't null and hold finite numbers; they have one length. Without any, of length 0."""
    x = F.col(vector).cast("array<double>")
    zero = (F.size(x) > 0) & ~F.exists(x, lambda v: v.isNull() | (v != 0))  # zero vectors count here
    return _added(rows.where(usable(F.col(vector)) | F.coalesce(zero, F.lit(False))).select(x.alias("x")))


def _added(x: DataFrame) -> Moments:
    """moments() of a column of vectors that all hold finite numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not len(batch):
                continue
            lists = batch.column(0)
            x = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
            x = np.hstack([x, np.ones((len(x), 1))])
            total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.record_batch([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "v"])

    sums = x.mapInArrow(run, "i int, j int, v double")
    got = sums.groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()  # half a matrix of the vectors' length
    if got.empty:
        return Moments(0, np.zeros(0), np.zeros((0, 0)))
    d = int(got["j"].max())
    gram = np.zeros((d + 1, d + 1))
    gram[got["i"], got["j"]] = gram[got["j"], got["i"]] = got["v"]
    n, mean = gram[d, d], gram[:d, d] / gram[d, d]
    return Moments(int(round(n)), mean, gram[:d, :d] / n - np.outer(mean, mean))


@dataclass(frozen=True)
class Projection:
    """(x - mean) / scale onto orthonormal components, with the variance along each of them."""

    mean: np.ndarray
    scale: np.ndarray
    components: np.ndarray
    variance: np.ndarray

    def apply(self, rows: DataFrame, key: str, vector: str) -> DataFrame:
        """(key, components) of rows or of a stream; null for a null vector."""
        mean, scale, parts = self.mean, self.scale, self.components

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                known = np.flatnonzero(pdf[vector].notna())
                out: list = [None] * len(pdf)
                if len(known):
                    made = ((np.stack(pdf[vector].to_numpy()[known]).astype(float) - mean) / scale) @ parts.T
                    for i, x in zip(known, made, strict=True):
                        out[i] = x
                yield pd.DataFrame({key: pdf[key].to_numpy(), "components": pd.Series(out, dtype=object)})

        return rows.select(key, vector).mapInPandas(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, components array<double>")

    def save(self, spark: SparkSession, path: str) -> None:
        """K7: a table of the numbers, and a manifest."""
        rows = [("mean", 0, self.mean.tolist()), ("scale", 0, self.scale.tolist()), ("variance", 0, self.variance.tolist()), *(("component", i, c.tolist()) for i, c in enumerate(self.components))]
        tables.write_parquet(spark.createDataFrame(rows, "kind string, at int, x array<double>"), f"{path}/numbers")
        tables.write_json(spark, {"dimensions": len(self.mean), "components": len(self.components)}, f"{path}/projection_manifest.json")


def load(spark: SparkSession, path: str) -> Projection:
    """A saved projection."""
    got = spark.read.schema("kind string, at int, x array<double>").parquet(f"{path}/numbers").toPandas().sort_values("at")  # a row per component
    one = lambda kind: np.array(got.loc[got["kind"] == kind, "x"].iloc[0])
    parts = got.loc[got["kind"] == "component", "x"].tolist()
    return Projection(one("mean"), one("scale"), np.array(parts).reshape(len(parts), len(one("mean"))), one("variance"))


def fit(rows: DataFrame, vector: str, dims: int, scaled: bool = True) -> Projection:
    """V2f, V2g: the scaler and the first principal components of all rows; a component without spread is scaled by 1.

    A component points where its largest entry (the first of equal ones) is positive.
    """
    m = moments(rows, vector)
    spread = np.sqrt(np.maximum(np.diag(m.covariance), 0))
    scale = np.where(spread > 1e-12, spread, 1.0) if scaled else np.ones(len(spread))
    values, axes = np.linalg.eigh(m.covariance / np.outer(scale, scale)) if len(spread) else (np.zeros(0), np.zeros((0, 0)))
    order = np.argsort(-values, kind="stable")[: min(dims, len(values))]
    parts = axes[:, order].T
    signs = np.sign(parts[np.arange(len(parts)), np.argmax(np.abs(parts).round(9), axis=1)]) if len(parts) else np.zeros(0)
    return Projection(m.mean, scale, parts * signs[:, None], np.maximum(values[order], 0))


def random_pairs(rows: DataFrame, key: str, columns: list[str], seed: int = 42) -> DataFrame:
    """(a, b): structs of key and columns of each row and the next one in a seeded hash order; a row less than rows."""
    return _in_pairs(_in_turn(rows, key, columns, seed)).where("a is not null")


def _in_turn(rows: DataFrame, key: str, columns: list[str], seed: int) -> DataFrame:
    """(b, _h, _rank): structs of key and columns with their place in a seeded hash order, written."""
    return ranked(rows.select(F.struct(key, *columns).alias("b"), hash_order(seed, F.col(key)).alias("_h")), [F.col("_h"), F.col(f"b.{key}")], "_rank")


def _in_pairs(at: DataFrame) -> DataFrame:
    """(a, b): each row and the one before it, null for the first. The last row of a block is in the next one as well."""
    own = F.floor(F.col("_rank") / BLOCK)
    both = at.select("b", "_rank", F.explode(F.array_distinct(F.array(own, F.floor((F.col("_rank") + 1) / BLOCK)))).alias("_block"))
    return both.withColumn("a", F.lag("b").over(Window.partitionBy("_block").orderBy("_rank"))).where(F.col("_block") == own).select("a", "b")


def collapse(rows: DataFrame, key: str, vector: str, label: str, seed: int = 42, least_spread: float = 1e-3, most_alike: float = 0.9) -> DataFrame:
    """Whether embeddings have collapsed; one row over the rows with a usable vector.

    rows, mean_norm, the least, mean and largest standard deviation of a dimension, effective_rank (the square of the
    covariance's trace over the sum of its squared entries), mean and quantiles of the cosines of random pairs, the
    mean of those with different labels, and collapsed: little spread in the mean, or random pairs too alike.
    """
    at = _in_turn(rows.where(usable(F.col(vector))).select(key, F.col(label).alias("label"), F.col(vector).alias("v")), key, ["label", "v"], seed)
    m = _added(at.select(F.col("b.v").cast("array<double>").alias("x")))
    spread = np.sqrt(np.maximum(np.diag(m.covariance), 0))
    square = float((m.covariance**2).sum())
    rank = float(np.trace(m.covariance)) ** 2 / square if square > 0 else 0.0
    # three numbers a row are written, so that vectors meet once and not for each figure
    met = _in_pairs(at).select(F.sqrt(dot(F.col("b.v"), F.col("b.v"))).alias("norm"), dot(unit(F.col("a.v")), unit(F.col("b.v"))).alias("c"), F.col("a.label").eqNullSafe(F.col("b.label")).alias("same"))
    met = written(met, "cosines")
    means = met.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.avg("norm"), F.lit(0.0)).alias("mean_norm"), F.avg("c").alias("random_cosine"), F.avg(F.when(~F.col("same"), F.col("c"))).alias("negative_cosine"))
    marks = quantiles(met, "c", {"q05": 0.05, "q50": 0.5, "q95": 0.95})
    stats = {"least_std": float(spread.min()) if len(spread) else 0.0, "mean_std": float(spread.mean()) if len(spread) else 0.0, "largest_std": float(spread.max()) if len(spread) else 0.0, "effective_rank": rank}
    whole = means.join(F.broadcast(marks))  # one row each
    out = whole.select("rows", "mean_norm", *[F.lit(v).alias(k) for k, v in stats.items()], "random_cosine", "negative_cosine", "q05", "q50", "q95")
    return out.withColumn("collapsed", (F.col("mean_std") < least_spread) | F.coalesce(F.col("random_cosine") > most_alike, F.lit(False)))
