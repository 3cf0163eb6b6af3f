"""Global ranks and exact quantiles without a task that sees all rows (survey W1, W12, A5-A7, A10).

Rows are sorted by range and written once with their range's number and their place in it; the counts of the ranges,
of which there are as many as shuffle partitions, turn both into a rank.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineweave.sources.scratch import written


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """rows with their position from 0 in the given order as a long; equal rows get different positions."""
    part, at = F.spark_partition_id(), F.monotonically_increasing_id()
    own = F.struct(part.alias("part"), (at - F.shiftleft(part.cast("long"), 33)).alias("at"))
    placed = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", own), "ranges")
    sizes = placed.groupBy("_place.part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()  # one row per range
    if not sizes:
        return placed.withColumn(name, F.lit(0).cast("long")).drop("_place")
    before = dict(zip((r["part"] for r in sizes), accumulate((r["n"] for r in sizes), initial=0), strict=False))
    ahead = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    return placed.withColumn(name, F.element_at(ahead, F.col("_place.part")).cast("long") + F.col("_place.at")).drop("_place")


def quantiles(rows: DataFrame, value: str, shares: dict[str, float], keys: list[str] | None = None) -> DataFrame:
    """quantiles_of() one column."""
    return quantiles_of(rows, {value: shares}, keys)


def quantiles_of(rows: DataFrame, wanted: dict[str, dict[str, float]], keys: list[str] | None = None) -> DataFrame:
    """One row per key (one row without keys) with interpolated quantiles of several columns' values that aren't null.

    wanted: for each column the names of its quantiles and their shares. All columns are ranked in one pass. A key
    without any value has no row; without keys and values the row holds nulls.
    """
    keys = keys or []
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_v")) for c in wanted])).alias("_e")
    own = rows.select(*keys, values).select(*keys, "_e._c", "_e._v").where("_v is not null")
    placed = ranked(own, [*[F.col(k) for k in keys], F.col("_c"), F.col("_v")], "_rank")
    groups = placed.groupBy(*keys, "_c").agg(F.min("_rank").alias("_first"), F.count(F.lit(1)).alias("_n"))
    at = lambda q: (F.col("_n") - 1) * F.lit(float(q))
    marks = [
        F.struct(F.lit(c).alias("c"), F.lit(name).alias("q"), (F.col("_first") + e(at(q))).cast("long").alias("_rank"), w.alias("w"))
        for c, shares in wanted.items() for name, q in shares.items() for e, w in ((F.floor, 1 - (at(q) - F.floor(at(q)))), (F.ceil, at(q) - F.floor(at(q))))
    ]
    asked = groups.select(*keys, F.inline(F.filter(F.array(*marks), lambda m: m.c == F.col("_c"))))
    got = asked.join(placed.select("_rank", "_v"), "_rank")
    return got.groupBy(*keys).agg(*[F.sum(F.when((F.col("c") == c) & (F.col("q") == name), F.col("_v") * F.col("w"))).alias(name) for c, shares in wanted.items() for name in shares])
