"""Samples and random pairs that no task sees as a whole."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import functions as F

from lineweave.functions.expressions import hash_order
from lineweave.operators import codebook, moments


def test_a_sample_is_drawn_where_rows_lie(spark, monkeypatch):
    monkeypatch.setattr(codebook, "DIGITS", 1, raising=False)  # 16 steps, so that some are cut
    rows = spark.range(900).select((F.col("id") % 800).alias("id")).repartition(4).unionByName(spark.sql("select cast(null as long) id"))
    for n in (0, 1, 57, 300, 900, 901, 2000):
        want = rows.orderBy(hash_order(7, F.col("id")), "id").limit(n).collect()
        got = codebook.sample(rows, "id", n, 7)
        assert sorted(map(str, got.collect())) == sorted(map(str, want)), n
        if n >= 300:
            assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert codebook.sample(rows.where("false"), "id", 5).collect() == []


def test_starts_of_a_fit_are_tasks_and_share_the_lengths(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    own = sorted(range(300), key=lambda i: hashlib.sha1(f"9|{i}".encode()).hexdigest())[:120]
    unit = x[own] / np.linalg.norm(x[own], axis=1, keepdims=True)
    want = min((codebook.mini_batch(unit.copy(), 3, 9000 + s, 64, 20) for s in range(3)), key=lambda m: m[1])[0]
    for parts in (1, 5):
        got = codebook.fit(rows.repartition(parts), "id", "vector", 3, 9, 120, batch=64, steps=20)
        assert np.allclose([c for _, c in got], want)


def test_random_pairs_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(moments, "BLOCK", 7, raising=False)
    for n in (0, 1, 2, 7, 8, 100):
        order = sorted(range(n), key=lambda i: hashlib.sha1(f"42|{i}".encode()).hexdigest())
        got = moments.random_pairs(spark.range(n).withColumn("x", F.col("id") * 2), "id", ["x"]).collect()
        assert sorted((r.a.id, r.a.x, r.b.id) for r in got) == sorted((a, 2 * a, b) for a, b in zip(order, order[1:], strict=False)), n


def test_vectors_meet_once_for_all_figures_of_collapse(spark, monkeypatch):
    monkeypatch.setattr(moments, "BLOCK", 16, raising=False)
    x = np.random.default_rng(6).normal(size=(90, 5))
    x[40:] *= 3
    odd = [(90, "l", None), (91, "l", [0.0] * 5), (92, "l", [float("nan")] * 5), (93, None, [1.0] * 5)]
    got = moments.collapse(spark.createDataFrame([(i, f"l{i % 2}", v.tolist()) for i, v in enumerate(x)] + odd, "id long, label string, v array<double>"), "id", "v", "label")
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    own = {**dict(enumerate(x)), 93: np.ones(5)}
    order = sorted(own, key=lambda i: hashlib.sha1(f"42|{i}".encode()).hexdigest())
    c = [own[a] @ own[b] / np.linalg.norm(own[a]) / np.linalg.norm(own[b]) for a, b in zip(order, order[1:], strict=False)]
    other = [s for s, a, b in zip(c, order, order[1:], strict=False) if 93 in (a, b) or a % 2 != b % 2]
    r, all_rows = got.first(), np.array(list(own.values()))
    assert r.rows == 91 and np.allclose((r.mean_norm, r.mean_std), (np.linalg.norm(all_rows, axis=1).mean(), all_rows.std(0).mean()))
    assert np.allclose((r.random_cosine, r.negative_cosine, r.q05, r.q50, r.q95), (np.mean(c), np.mean(other), *np.quantile(c, (0.05, 0.5, 0.95))))
