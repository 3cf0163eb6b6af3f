"""A neighbour index of inverted cell lists (survey V4, K6, S4): built once, saved, loaded and searched without refitting.

Rows lie in the cell of the most similar centre. Centres come from two levels of spherical k-means, the second within
each centre of the first, both on samples of bounded size; their number grows with the rows. An index is a folder:

    centres  cell, centre           lists  cell, id, vector and what else is to be kept, sorted by cell
    sizes    cell, n                manifest.json  rows, probes, the recall that they gave, settings

A search looks a query up in the `probes` cells with the most similar centres. How many those are is measured when the
index is built: as few as find `target` of the exact neighbours of up to CHECKED rows. Queries meet a cell's rows in
blocks; a cell with many rows or many queries is split over tasks. Queries that find fewer than k rows are searched
exactly, so that each gets k rows where there are as many.

Null and zero vectors, and such with null or non-finite components, are neither rows nor queries. Ties go to the smaller
id. Vectors have one length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineweave.functions.expressions import hash_order
from lineweave.operators import vectors
from lineweave.sources import tables
from lineweave.sources.scratch import written

#: Rows that a cell has on average; most cells by their number and by the bytes of their centres.
CELL, MOST_CELLS, MOST_BYTES = 1000, 1 << 16, 1 << 26
#: Rows of a sample at most, and its bytes; sampled rows for each cell.
SAMPLE, SAMPLE_BYTES, EACH = 1 << 16, 1 << 27, 32
#: Rows and queries of one block.
ROWS, QUERIES = 8192, 4096
#: Queries times cells that a search deals out at a time, each with its vector.
PROBED = 8192
#: Rows whose exact neighbours tell how many cells to look at, and how many neighbours.
CHECKED, NEIGHBOURS = 256, 10


@dataclass(frozen=True)
class Index:
    """A saved index: its centres, which are bounded, and where its lists are."""

    spark: SparkSession
    path: str
    centres: np.ndarray
    about: dict

    def lists(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/lists")


def usable(vector: Column) -> Column:
    """Whether a vector has a direction."""
    x = vector.cast("array<double>")
    fine = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(fine & F.exists(x, lambda v: v != 0), F.lit(False))


def kmeans(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """k unit centres of unit rows, or as many as there are distinct rows; a centre without rows takes the row that fits worst."""
    first = np.unique(x.round(12), axis=0, return_index=True)[1]
    k = min(k, len(first))
    centres = x[np.sort(first)[:: max(1, len(first) // k)][:k]].copy()
    for _ in range(rounds):
        s = x @ centres.T
        own = np.argmax(s, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norms = np.linalg.norm(sums, axis=1)
        bad = np.flatnonzero(norms < 1e-9)
        sums[bad] = x[np.argsort(s[np.arange(len(x)), own], kind="stable")[: len(bad)]]
        new = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, centres, atol=1e-7):
            break
        centres = new
    return centres


def _nearest_cell(rows: DataFrame, centres: np.ndarray, name: str) -> DataFrame:
    """rows (with vector) and the number of the most similar centre, the first of equal ones, found in block products."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 1024):
                part = pdf.iloc[lo : lo + 1024]
                yield part.assign(**{name: np.argmax(np.round(vectors._unit_rows(part["vector"]) @ shared.value.T, 12), axis=1).astype(np.int32)})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{kinds}, {name} int")


def _fit(rows: DataFrame, n: int, cell: int, seed: int) -> np.ndarray:
    """Unit centres, those of one centre of the first level together."""
    dims = len(rows.select("vector").first()[0])
    cells = min(-(-n // cell), MOST_CELLS, max(1, MOST_BYTES // (8 * dims)))
    most = min(SAMPLE, max(1024, SAMPLE_BYTES // (8 * dims)))
    order = hash_order(seed, F.col("id"))
    sample = vectors._unit_rows(rows.orderBy(order, "id").limit(most).select("vector").toPandas()["vector"])
    tops = kmeans(sample, int(np.ceil(np.sqrt(cells))))
    share = min(1.0, EACH * cells / n)
    wide = rows.select("id", "vector").where((F.pmod(F.xxhash64("id"), F.lit(1 << 20)) + 1) / (1 << 20) <= share) if share < 1 else rows.select("id", "vector")
    placed = _nearest_cell(wide, tops, "top")
    held = placed.withColumn("_turn", F.row_number().over(Window.partitionBy("top").orderBy(order, "id"))).where(F.col("_turn") <= most).drop("_turn")
    each = -(-cells // len(tops))

    def second(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        return pd.DataFrame({"top": pdf["top"].iloc[0], "centre": list(kmeans(vectors._unit_rows(pdf["vector"]), each))})

    got = held.groupBy("top").applyInPandas(second, "top int, centre array<double>").toPandas()  # MOST_CELLS rows, MOST_BYTES at most
    return np.stack(got.sort_values("top", kind="stable")["centre"].to_numpy())


def build(rows: DataFrame, path: str, cell: int = CELL, target: float = 0.97, seed: int = 42, keep: list[str] | None = None) -> Index:
    """Index all rows (id, vector and the columns to keep) in a new folder, and measure how many cells a search needs."""
    spark = rows.sparkSession
    good = rows.select("id", "vector", *(keep or [])).where(usable(F.col("vector"))).withColumn("vector", F.col("vector").cast("array<double>"))
    n = good.count()
    centres = _fit(good, n, cell, seed) if n else np.zeros((0, 0))
    about = {"cell": cell, "target": target, "seed": seed}
    if n:
        _place(good, centres, path, "overwrite")
    else:
        good.withColumn("cell", F.lit(0)).write.parquet(f"{path}/lists")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").write.parquet(f"{path}/centres")
    _sizes(spark, path)
    index = Index(spark, path, centres, about | {"rows": n, "probes": max(1, len(centres)), "recall": 1.0})
    if n > 1:
        probes, recall = _calibrated(index, target)
        index = Index(spark, path, centres, index.about | {"probes": probes, "recall": recall})
    tables.write_json(spark, index.about, f"{path}/manifest.json")
    return index


def _place(good: DataFrame, centres: np.ndarray, path: str, mode: str) -> None:
    """Rows into the lists, sorted by cell, so that a search reads the cells it needs; a large cell is several files."""
    placed = _nearest_cell(good, centres, "cell")
    placed.repartitionByRange("cell", F.xxhash64("id")).sortWithinPartitions("cell").write.mode(mode).parquet(f"{path}/lists")


def _sizes(spark: SparkSession, path: str) -> None:
    spark.read.parquet(f"{path}/lists").groupBy("cell").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/sizes")


def add(index: Index, rows: DataFrame) -> Index:
    """Further rows, with the columns that the index keeps, in its cells; centres and probes stay as they are."""
    keep = [c for c in index.lists().columns if c not in ("cell", "id", "vector")]
    good = rows.select("id", "vector", *keep).where(usable(F.col("vector"))).withColumn("vector", F.col("vector").cast("array<double>"))
    if not len(index.centres):
        raise ValueError("an index without rows has no cells to add to")
    _place(good, index.centres, index.path, "append")
    _sizes(index.spark, index.path)
    about = index.about | {"rows": index.lists().count()}
    tables.write_json(index.spark, about, f"{index.path}/manifest.json")
    return Index(index.spark, index.path, index.centres, about)


def load(spark: SparkSession, path: str) -> Index:
    """A saved index."""
    got = spark.read.schema("cell int, centre array<double>").parquet(f"{path}/centres").toPandas().sort_values("cell")  # MOST_CELLS rows at most
    centres = np.stack(got["centre"].to_numpy()) if len(got) else np.zeros((0, 0))
    return Index(spark, path, centres, tables.read_json(spark, f"{path}/manifest.json"))


def _calibrated(index: Index, target: float) -> tuple[int, float]:
    """The least number of cells that hold `target` of the exact neighbours of CHECKED rows, and the share they hold."""
    rows = index.lists().select("id", "vector", "cell")
    asked = written(rows.orderBy(hash_order(index.about["seed"], F.col("id")), "id").limit(CHECKED), "checked")
    found = vectors.nearest(rows, asked, NEIGHBOURS, other_score=False).join(rows.select("id", "cell"), "id").select("query_id", "cell").toPandas()
    own = asked.select("id", "vector").toPandas()  # CHECKED rows
    order = np.argsort(-(vectors._unit_rows(own["vector"]) @ index.centres.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    at = dict(zip(own["id"], range(len(own)), strict=True))
    ranks = np.sort(np.array([place[at[q], c] for q, c in found.itertuples(index=False)]))
    probes = int(ranks[max(0, int(np.ceil(target * len(ranks))) - 1)]) + 1
    return probes, float((ranks < probes).mean())


def search(index: Index, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """(query_id, rank, id, similarity): k similar rows for each query, never the query itself."""
    spark, probes = index.spark, min(probes or index.about["probes"], max(1, len(index.centres)))
    asked = queries.select(F.col("id").alias("query_id"), F.col("vector").cast("array<double>").alias("vector")).where(usable(F.col("vector")))
    kind, own = queries.schema["id"].dataType.simpleString(), index.lists().schema["id"].dataType.simpleString()
    if not index.about["rows"]:
        return spark.createDataFrame([], f"query_id {kind}, rank int, id {own}, similarity double")
    shared = spark.sparkContext.broadcast(index.centres)
    step = max(1, min(512, PROBED // probes))

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), step):
                part = pdf.iloc[lo : lo + step]
                cells = np.argsort(-(vectors._unit_rows(part["vector"]) @ shared.value.T), axis=1, kind="stable")[:, :probes]
                yield part.loc[part.index.repeat(probes)].assign(cell=cells.ravel().astype(np.int32))

    looked = asked.mapInPandas(probe, f"query_id {kind}, vector array<double>, cell int")
    sizes = spark.read.schema("cell int, n long").parquet(f"{index.path}/sizes")
    wanted = looked.groupBy("cell").agg(F.count(F.lit(1)).alias("m"))
    plan = written(sizes.join(wanted, "cell").select("cell", F.ceil(F.col("n") / ROWS).cast("int").alias("slices"), F.ceil(F.col("m") / QUERIES).cast("int").alias("parts")), "plan")
    small = F.broadcast(plan)  # a row per cell, MOST_CELLS at most
    split = lambda key, among: F.pmod(F.xxhash64(key), F.col(among).cast("long")).cast("int")
    every = lambda among: F.explode(F.sequence(F.lit(0), F.col(among) - 1))
    left = looked.join(small, "cell").select("cell", every("slices").alias("slice"), split("query_id", "parts").alias("part"), "query_id", "vector")
    rows = index.lists().select("cell", "id", "vector")
    some = [r["cell"] for r in plan.select("cell").limit(501).collect()]
    rows = rows.where(F.col("cell").isin(some)) if len(some) <= 500 else rows  # few cells: only their files are read
    right = rows.join(small, "cell").select("cell", split("id", "slices").alias("slice"), every("parts").alias("part"), "id", "vector")

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            b = b.sort_values("id", kind="stable")
            ids, x = b["id"].to_numpy(), vectors._unit_rows(b["vector"])
            for lo in range(0, len(a), 512):
                part = a.iloc[lo : lo + 512]
                q = part["query_id"].to_numpy()
                s = np.round(vectors._unit_rows(part["vector"]) @ x.T, 9)
                s[q[:, None] == ids] = -np.inf
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                value = np.take_along_axis(s, top, 1)
                ok = np.isfinite(value)
                out.append(pd.DataFrame({"query_id": np.repeat(q, ok.sum(1)), "id": ids[top[ok]], "similarity": value[ok]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "similarity": []})

    by = ["cell", "slice", "part"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(best, f"query_id {kind}, id {own}, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    done = written(found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "similarity"), "found")
    full = done.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("query_id")
    short = written(asked.join(full, "query_id", "left_anti").select(F.col("query_id").alias("id"), "vector"), "short")
    if short.isEmpty():
        return done
    exact = vectors.nearest(index.lists().select("id", "vector"), short, k, other_score=False)
    return done.join(full, "query_id", "left_semi").unionByName(exact)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact neighbours that were found."""
    hits = exact.join(found.select("query_id", "id"), ["query_id", "id"], "left_semi").count()
    return hits / max(1, exact.count())
