"""Connected components against union-find."""

from __future__ import annotations

import random

import pytest

from lineweave.llm.components import components


@pytest.mark.parametrize("shape", ["random", "chain", "star", "none"])
def test_components(spark, shape):
    rng = random.Random(1)
    links = {
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(220)], "chain": [(k, k + 1) for k in rng.sample(range(120), 120)],
        "star": [(77, k) for k in range(150)], "none": [(3, 3), (None, 4), (5, None)],
    }[shape]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in links:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    want = {i: find(i) for i in root if find(i) != i}
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
