"""The neighbour index: recall against the exact search, all k rows, saved and loaded, hot cells, odd vectors."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineweave.operators import ann, vectors
from lineweave.plans import commands


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_embeddings(spark, tmp_path, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = rows.where("id % 50 = 0")
    ann.build(rows, str(tmp_path / "i"), cell=64)
    index = ann.load(spark, str(tmp_path / "i"))
    found, exact = ann.search(index, asked, 10), vectors.nearest(rows, asked, 10, other_score=False)
    assert index.about["rows"] == rows.count() and len(index.centres) >= rows.count() // 64 and index.about["recall"] >= 0.97
    assert {r["count"] for r in found.groupBy("query_id").count().collect()} == {10} and found.select("query_id").distinct().count() == asked.count()
    print(sf, ann.recall(found, exact), index.about)
    assert ann.recall(found, exact) >= 0.9
    assert sorted(map(tuple, ann.search(index, asked, 10, probes=len(index.centres)).collect())) == sorted(map(tuple, exact.collect()))


def clusters(spark, n=300, dims=16, seed=2, kind="long"):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    return spark.createDataFrame([(k, (centres[k % 12] + rng.normal(size=dims) * 0.2).tolist()) for k in range(n)], "id long, vector array<double>").withColumn("id", F.col("id").cast(kind))


def test_few_cells_are_looked_at(spark, tmp_path):
    rows = clusters(spark)
    index = ann.build(rows, str(tmp_path / "i"), cell=10)
    assert index.about["probes"] < len(index.centres) / 2
    asked = rows.where("id % 7 = 0")
    assert ann.recall(ann.search(index, asked, 5), vectors.nearest(rows, asked, 5, other_score=False)) >= 0.9
    # a query that finds too little in its cells is searched exactly
    assert sorted(map(tuple, ann.search(index, asked, 120, probes=1).collect())) == sorted(map(tuple, vectors.nearest(rows, asked, 120, other_score=False).collect()))
    assert ann.search(index, asked, 400).groupBy("query_id").count().agg(F.min("count")).first()[0] == 299


def test_hot_cells_are_split(spark, tmp_path, monkeypatch):
    """A third of all rows are one vector; blocks of rows and of queries are small."""
    monkeypatch.setattr(ann, "ROWS", 20)
    monkeypatch.setattr(ann, "QUERIES", 8)
    rows = clusters(spark, kind="string").withColumn("vector", F.when(F.col("id") % 3 == 0, F.array(*[F.lit(0.5)] * 16)).otherwise(F.col("vector")))
    index = ann.build(rows, str(tmp_path / "i"), cell=15)
    every = ann.search(index, rows, 4, probes=len(index.centres))
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, vectors.nearest(rows, rows, 4, other_score=False).collect()))


def test_odd_vectors_and_more_rows(spark, tmp_path):
    odd = spark.createDataFrame([(1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [1.0, 0.0]), (6, [1.0, 0.1]), (7, [0.0, 1.0]), (8, [1.0, 0.0])], "id long, vector array<double>")
    index = ann.build(odd, str(tmp_path / "i"), cell=1)
    assert index.about["rows"] == 4
    got = sorted((r.query_id, r.rank, r.id) for r in ann.search(index, odd, 2).collect())
    assert got == [(5, 1, 8), (5, 2, 6), (6, 1, 5), (6, 2, 8), (7, 1, 6), (7, 2, 5), (8, 1, 5), (8, 2, 6)]
    more = ann.add(index, spark.createDataFrame([(9, [0.0, 2.0]), (10, None)], "id long, vector array<double>"))
    assert more.about["rows"] == ann.load(spark, str(tmp_path / "i")).about["rows"] == 5
    assert [(r.rank, r.id) for r in ann.search(more, odd.where("id = 7"), 1).collect()] == [(1, 9)]
    none = ann.build(odd.where("id < 5"), str(tmp_path / "none"))
    assert ann.search(ann.load(spark, str(tmp_path / "none")), odd, 3).collect() == [] and none.about["rows"] == 0
    one = ann.build(odd.where("id = 5"), str(tmp_path / "one"))
    assert [tuple(r)[:3] for r in ann.search(one, odd.where("id > 5"), 3).collect()] == [(6, 1, 5), (7, 1, 5), (8, 1, 5)] and ann.search(one, odd.where("id = 5"), 3).collect() == []


def test_empty_searches_keep_their_columns(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "id string, vector array<double>")
    for kind in ("string", "long"):
        got = vectors.nearest(rows.withColumn("id", F.col("id").cast(kind)), rows.where("false").withColumn("id", F.col("id").cast(kind)), 3, other_score=False)
        assert got.columns == ["query_id", "rank", "id", "similarity"] and got.collect() == [] and got.schema["id"].dataType.typeName() == kind
    table = rows.withColumn("score_id", F.col("id")).withColumn("segment_id", F.col("id")).withColumn("split", F.lit("train")).withColumn("extraction_mode", F.lit("explicit_voice")).withColumn("n_bars", F.lit(1))
    assert commands.evaluate_backends({"own": table}).select("rank").collect() == []


def test_learned_index(spark, tmp_path):
    rows = spark.createDataFrame([(f"s{k}", f"score{k % 3}", [[k, 1, 2, 3, 4]]) for k in range(12)], "segment_id string, score_id string, tokens array<array<int>>")
    commands.save_learned_index(rows, lambda t: np.array([[x[0][0] + 1.0, 3.0] for x in t]), str(tmp_path / "i"), cell=4)
    index = ann.load(spark, str(tmp_path / "i"))
    assert index.about["rows"] == 12 and set(index.lists().columns) == {"cell", "id", "vector", "score_id", "split"}
    assert {r.split for r in index.lists().collect()} <= {"train", "validation", "test"}
    asked = index.lists().where("id = 's5'").select("id", "vector")
    assert {r.id for r in ann.search(index, asked, 2).collect()} == {"s4", "s6"}
