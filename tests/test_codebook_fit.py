"""The mini-batch fit against full k-means, and that it depends on the rows alone."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from lineweave.operators import codebook
from lineweave.operators.vectors import _unit_rows


def inertia(x, centres):
    return float((1 - (x @ centres.T).max(1)).sum())


@pytest.mark.parametrize("batch", [8192, 700])
def test_inertia_is_that_of_full_kmeans(spark, batch):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x = _unit_rows(rows.orderBy("vec_id").toPandas()["embedding"])
    for k in (10, 32):
        full = KMeans(k=k, seed=1, distanceMeasure="cosine", maxIter=100).fit(rows.orderBy("vec_id").select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features")))
        centres = np.array(full.clusterCenters())
        want = inertia(x, centres / np.linalg.norm(centres, axis=1, keepdims=True))
        got = codebook.fit(rows, "vec_id", "embedding", k, batch=batch)
        assert [i for i, _ in got] == list(range(k)) and np.allclose(np.linalg.norm([c for _, c in got], axis=1), 1)
        assert inertia(x, np.array([c for _, c in got])) <= 1.02 * want


def test_rows_alone_count(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    a = codebook.fit(rows.repartition(1), "vec_id", "embedding", 6)
    b = codebook.fit(rows.repartition(5).orderBy(F.desc("vec_id")), "vec_id", "embedding", 6)
    assert a == b != codebook.fit(rows, "vec_id", "embedding", 6, seed=7)
    assert len(codebook.fit(rows, "vec_id", "embedding", 6, fit_sample=20)) == 6


def test_few_and_odd_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None)], "id long, v array<double>")
    assert all(np.allclose(c, [1, 0]) for _, c in codebook.fit(df, "id", "v", 3))
    with pytest.raises(ValueError, match="no vectors"):
        codebook.fit(df.where("id = 3"), "id", "v", 2)
