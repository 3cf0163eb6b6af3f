"""Moments, projection and collapse against numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineweave.operators import codebook, moments


def table(spark, x):
    return spark.createDataFrame([(k, f"l{k % 3}", r.tolist()) for k, r in enumerate(x)], "id long, label string, v array<double>").repartition(3)


@pytest.fixture
def data():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 6)) @ rng.normal(size=(6, 6)) + 5
    x[:, 4] = 2.0
    return x


def test_moments(spark, data):
    odd = spark.createDataFrame([(1000, "l", None), (1001, "l", [None] * 6), (1002, "l", [float("nan")] * 6)], "id long, label string, v array<double>")
    m = moments.moments(table(spark, data).unionByName(odd), "v")
    assert m.n == 200 and np.allclose(m.mean, data.mean(0)) and np.allclose(m.covariance, np.cov(data.T, bias=True), atol=1e-9)
    assert moments.moments(odd.limit(1), "v").n == 0 and moments.moments(spark.createDataFrame([(1, [0.0, 0.0])], "id long, v array<double>"), "v").n == 1


def test_projection_is_saved_and_applied(spark, data, tmp_path):
    df = table(spark, data)
    made = moments.fit(df, "v", 3)
    made.save(spark, str(tmp_path / "p"))
    again = moments.load(spark, str(tmp_path / "p"))
    for a, b in zip((made.mean, made.scale, made.components, made.variance), (again.mean, again.scale, again.components, again.variance), strict=True):
        assert (a == b).all()
    z = (data - data.mean(0)) / np.where(data.std(0) > 1e-12, data.std(0), 1)
    _, s, axes = np.linalg.svd(z, full_matrices=False)
    assert np.allclose(made.variance, s[:3] ** 2 / 200) and np.allclose(np.abs(np.sum(made.components * axes[:3], axis=1)), 1)
    got = np.array([r.components for r in again.apply(df, "id", "v").orderBy("id").collect()])
    assert np.allclose(got, z @ made.components.T)
    assert again.apply(spark.createDataFrame([(1, None)], "id long, v array<double>"), "id", "v").first().components is None
    # rows of a stream are projected alike
    df.write.parquet(str(tmp_path / "in"))
    q = again.apply(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "id", "v").writeStream.format("memory").queryName("projected").trigger(availableNow=True).start()
    assert q.awaitTermination(120) and np.allclose(np.array([r.components for r in spark.table("projected").orderBy("id").collect()]), got)
    centred = np.array([r.components for r in codebook.components(df, "id", "v", 2).orderBy("id").collect()])
    assert np.allclose(centred.var(0), np.sort(np.linalg.eigvalsh(np.cov(data.T, bias=True)))[::-1][:2])


def test_collapse(spark, data):
    rng = np.random.default_rng(2)
    got = moments.collapse(table(spark, rng.normal(size=(300, 8))), "id", "v", "label").first()
    assert not got.collapsed and got.rows == 300 and got.effective_rank > 7 and abs(got.random_cosine) < 0.1 and got.q05 < got.q50 < got.q95
    same = moments.collapse(table(spark, np.ones((50, 8)) + rng.normal(size=(50, 8)) * 1e-6), "id", "v", "label").first()
    assert same.collapsed and same.random_cosine > 0.99 and same.negative_cosine > 0.99
    pairs = moments.random_pairs(table(spark, data), "id", ["label"]).select("a.id", F.col("b.id").alias("other")).collect()
    assert len(pairs) == 199 and len({r.id for r in pairs}) == 199 and len({r.other for r in pairs}) == 199
    none = moments.collapse(table(spark, data).where("false"), "id", "v", "label").first()
    assert none.rows == 0 and none.random_cosine is None and none.collapsed
