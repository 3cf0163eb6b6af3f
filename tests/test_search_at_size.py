"""Exact search keeps one best list per task; a search of the index deals out bounded batches."""

from __future__ import annotations

import numpy as np

from lineweave.operators import ann, vectors


def test_a_task_gives_its_best_rows_once(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 6)).round(1)
    x[100:160] = x[100]  # copies tie
    x[7] = 0
    rows = spark.createDataFrame([(int(i), int(i % 9), v.tolist()) for i, v in enumerate(x)], "id long, score_id long, vector array<double>").coalesce(1)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8)
    s = np.round(unit @ unit.T, 9)
    want = []
    for q in range(900):
        order = [i for i in np.lexsort((np.arange(900), -s[q])) if i != q and i % 9 != q % 9 and i != 7][:10]
        want += [(q, r + 1, int(i), s[q, i]) for r, i in enumerate(order)]
    for most in (20_000, 250):
        monkeypatch.setattr(vectors, "MOST_QUERIES", most)
        got = vectors.nearest(rows, rows, 10).orderBy("query_id", "rank").collect()
        assert [(r.query_id, r.rank, r.id) for r in got] == [w[:3] for w in want]
        assert np.allclose([r.similarity for r in got], [w[3] for w in want], atol=2e-9)
    q = rows.toPandas()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        part = vectors._block(rows, q, ["id", "score_id"], 10, "query_id long, id long, similarity double", False, True, False, None)
        given = part.count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert given == 900 * 10  # not ten for each of nine batches


def test_probing_is_bounded_by_queries_times_cells(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(rng.normal(size=(600, 5)))], "id long, vector array<double>")
    index = ann.build(rows, f"{tmp_path}/index", cell=20)
    whole = ann.search(index, rows, 5, probes=12).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(ann, "PROBED", 24)
    assert ann.search(index, rows, 5, probes=12).orderBy("query_id", "rank").collect() == whole
