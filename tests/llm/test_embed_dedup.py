"""Embedding near-dedup against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from lineweave.llm import embed_dedup


def brute(rows, least):
    unit = {}
    for i, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            unit[i] = np.array(v, float) / np.linalg.norm(np.array(v, float))
    root, links = {i: i for i, _ in rows}, dict.fromkeys([i for i, _ in rows], 0)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(unit)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (links[i], find(i)) for i, _ in rows}


@pytest.mark.parametrize(("block", "per_cell"), [(8 << 20, 4096), (32 * 16 * 8, 40)])
def test_same_as_brute_force(spark, monkeypatch, block, per_cell):
    """With small cells and blocks all ways through the comparison are used."""
    monkeypatch.setattr(embed_dedup, "BLOCK_BYTES", block)
    monkeypatch.setattr(embed_dedup, "PER_CELL", per_cell)
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(40):
        c = rng.normal(size=16)
        rows += [(len(rows) + k, (c + rng.normal(size=16) * rng.choice([0.05, 0.3, 0.5])).tolist()) for k in range(rng.integers(1, 20))]
    rows += [(len(rows) + k, rows[5][1]) for k in range(30)] + [(len(rows) + 100 + k, [2 * x for x in rows[6][1]]) for k in range(3)]
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), margin=None).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute(rows, 0.9)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_bad_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [1.0, float("nan")]), (8, [float("inf"), 1.0]), (9, [1.0, 0.0, 0.0]), (10, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("vec_id", "embedding", "1 as unit", "2 as item", "3 as cell")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(df).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 10: (2, 1, False)} | {k: (0, k, True) for k in (3, 4, 5, 6, 7, 8, 9)}
    assert embed_dedup.near_duplicates(df.limit(0)).collect() == []


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(df).collect())
    assert got == [(False, 1, 2, 1, True), (False, 1, 2, 1, True), (False, 2, 0, 2, True), (True, 0, 2, None, True)]


@pytest.mark.parametrize("dims", [64, 16])
def test_recall_between_cells(spark, monkeypatch, dims):
    """Pairs just above the threshold in vectors without structure, over many cells; none below it, few copies."""
    monkeypatch.setattr(embed_dedup, "PER_CELL", 128)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away = rng.normal(size=x.shape)
    away -= (away * x).sum(1, keepdims=True) * x
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    both = np.concatenate([x, 0.905 * x + np.sqrt(1 - 0.905**2) * away]).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(both)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(df).collect()}
    unit = both.astype(float) / np.linalg.norm(both.astype(float), axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.9).sum(1) - 1
    found = np.array([got[k] for k in range(len(both))])
    assert (found <= links).all() and found.sum() / links.sum() >= 0.95
    centres = embed_dedup.spherical_kmeans(unit[::2], 93)
    gap = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0))
    slack = embed_dedup.MARGIN * np.sqrt(1 - 0.81) / np.sqrt(dims)
    _, row, _ = embed_dedup._visits(unit, centres, gap, slack)
    assert len(row) / len(unit) < 4


def test_ids_that_are_no_numbers(spark):
    with pytest.raises(TypeError, match="whole numbers"):
        embed_dedup.near_duplicates(spark.createDataFrame([("a", [1.0])], "vec_id string, embedding array<float>"))
