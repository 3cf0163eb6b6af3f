"""Pairs of segments against brute force, with most rows in one score and blocks far smaller than that."""

from __future__ import annotations

import numpy as np
import pytest

from lineweave.operators import vectors

ROW = "id string, score_id string, part_id long, split string, start_q double, end_q double, bars double, vector array<double>"


def brute(rows, least, ratio, keep):
    unit = {r[0]: np.array(r[7]) / np.linalg.norm(r[7]) for r in rows}
    out = {}
    for a in rows:
        found = []
        for b in rows:
            if a[0] != b[0] and a[1:4] == b[1:4] and (b[5] <= a[4] or b[4] >= a[5]) and ratio[0] <= b[6] / max(1e-6, a[6]) <= ratio[1] and (s := round(float(unit[a[0]] @ unit[b[0]]), 9)) >= least:
                found.append((-s, b[0]))
        out[a[0]] = [x for _, x in sorted(found)[:keep]]
    return {(a, b) for a, x in out.items() for b in x}


@pytest.mark.parametrize("grid", [5, 37, 2048])
@pytest.mark.parametrize("ratio", [(0.75, 1.33), (0.0, 10.0)])
def test_pairs_of_a_hot_score(spark, monkeypatch, grid, ratio):
    monkeypatch.setattr(vectors, "GRID", grid)
    rng = np.random.default_rng(4)
    rows = [(f"s{k}", "hot" if k % 10 else f"x{k % 3}", int(k % 2), "train", float(rng.integers(0, 60)), 0.0, float(rng.choice([1.0, 1.2, 2.0, 4.0])), rng.normal(size=4).tolist()) for k in range(160)]
    rows = [(*r[:5], r[4] + r[6], *r[6:]) for r in rows]
    odd = [("n1", None, 1, "train", 0.0, 1.0, 1.0, [1.0] * 4), ("n2", "hot", 1, "train", 0.0, 1.0, 1.0, None), ("n3", "hot", 1, "train", None, 1.0, 1.0, [1.0] * 4)]
    df = spark.createDataFrame(rows + odd, ROW)
    got = vectors.mine_pairs(df, 0.3, ratio, 5, 3).collect()
    assert {(r.id_a, r.id_b) for r in got} == brute(rows, 0.3, ratio, 3) and len(got) == len({(r.id_a, r.id_b) for r in got})
    both = {(r.id_a, r.id_b) for r in vectors.mine_pairs(df, 0.3, ratio, 5, 3, reciprocal=True).collect()}
    assert both == {p for p in brute(rows, 0.3, ratio, 3) if p[::-1] in brute(rows, 0.3, ratio, 3)}
    assert vectors.mine_pairs(df.where("false"), 0.3, ratio, 5, 3).collect() == []
