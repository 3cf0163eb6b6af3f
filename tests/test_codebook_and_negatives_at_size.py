"""Steps that grew faster than their input: lengths of vectors, sweeps, hard negatives."""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import functions as F

from lineweave.functions.expressions import unit
from lineweave.operators import codebook, dataset, vectors


def test_length_is_computed_once_per_vector(spark):
    rows = spark.range(300).select(F.transform(F.sequence(F.lit(1), F.lit(3000)), lambda i: (i + F.col("id")).cast("double")).alias("v"))
    began = time.time()
    got = rows.select(F.aggregate(unit(F.col("v")), F.lit(0.0), lambda s, x: s + x * x).alias("n")).agg(F.min("n"), F.max("n")).first()
    assert abs(got[0] - 1) < 1e-9 and abs(got[1] - 1) < 1e-9
    assert time.time() - began < 15  # with a length per component 2.7 billion steps
    assert spark.sql("select cast(null as array<double>) v").select(unit(F.col("v")).alias("u")).first().u is None


def test_a_sweep_sorts_nothing(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(200)], "id long, vector array<double>")
    want = {k: codebook.build(rows, "id", "vector", k) for k in (2, 3)}
    exact = {k: (m["cohesion"].first().quantization_error, m["cohesion"].first().mean_margin, m["vocabulary"].first().entropy) for k, m in want.items()}
    monkeypatch.setattr(vectors, "ranked", None)
    for r in codebook.sweep(rows, "id", "vector", [2, 3]).collect():
        assert np.allclose((r.quantization_error, r.mean_margin, r.entropy), exact[r.k])


def test_queries_that_are_alike_are_asked_once(spark, monkeypatch):
    rows = spark.range(400).select("id", F.concat(F.lit("T"), F.col("id") % 3).alias("token"), (F.col("id") % 4).alias("score_id"), F.when(F.col("id") % 7 > 0, F.col("id") % 5).alias("n_bars"), (F.col("id") % 2).alias("n_notes"))
    asked = rows.where("id % 2 = 0")
    want = sorted(map(tuple, dataset.hard_negatives(rows, asked).collect()))
    assert len(want) == 200
    kinds = asked.select("token", "score_id", "n_bars", "n_notes").distinct().count()
    assert kinds < 200
    met = []
    real = dataset.written
    monkeypatch.setattr(dataset, "written", lambda df, name: met.append((name, (out := real(df, name)).count())) or out)
    assert sorted(map(tuple, dataset.hard_negatives(rows, asked).collect())) == want
    assert dict(met)["kinds"] == kinds and dict(met)["answers"] == kinds
