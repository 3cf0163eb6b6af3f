"""Two-level scans against the plain windows and brute force, with blocks far smaller than a key."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lineweave.operators import notes as N
from lineweave.operators import scans


def table(spark, n=200, seed=1):
    """Half of all rows have one key; some keys, times and values are null; times repeat."""
    rng = random.Random(seed)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.randrange(60), i, rng.choice([None, None, rng.randrange(9)])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, t long, id long, v long").repartition(5)


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_scans_equal_windows(spark, size):
    _, df = table(spark)
    w = Window.partitionBy("k").orderBy("t", "id")
    want = df.withColumn("last", F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("own", F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    want = want.withColumn("next", F.first("v", True).over(w.rowsBetween(1, Window.unboundedFollowing))).withColumn("sum", F.coalesce(F.sum("v").over(w), F.lit(0)))
    at = scans.placed(df, ["k"], [F.col("t"), F.col("id")], size)
    at = scans.last_before(at, ["k"], F.col("v"), "last")
    at = scans.last_before(at, ["k"], F.col("v"), "own", own=True)
    at = scans.last_before(at, ["k"], F.col("v"), "next", after=True)
    got = scans.unplaced(scans.running_sum(at, ["k"], F.col("v"), "sum"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.columns == want.columns
    assert scans.unplaced(scans.running_sum(scans.placed(df.limit(0), ["k"], [F.col("t")]), ["k"], F.col("v"), "s")).collect() == []


@pytest.mark.parametrize("after", [False, True])
@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("tolerance", [None, 4])
def test_as_of(spark, after, strict, tolerance):
    a, left = table(spark, 120, 2)
    b, right = table(spark, 90, 3)
    a, b = a + [("a", None, 900, 1)], b + [("a", None, 901, 1)]
    left, right = left.unionByName(spark.createDataFrame(a[-1:], left.schema)), right.unionByName(spark.createDataFrame(b[-1:], right.schema))
    got = scans.as_of(left, right.withColumnRenamed("v", "value").withColumnRenamed("id", "other"), ["k"], "t", ["other", "value"], None if tolerance is None else F.lit(tolerance), after, strict, size=7)
    want = []
    for k, t, i, v in a:
        near = [(u, j, x) for key, u, j, x in b if key == k and u is not None and t is not None and ((u > t if strict else u >= t) if after else (u < t if strict else u <= t))]
        low = lambda m: (m[0], m[1])
        m = (min(near, key=low) if after else max(near, key=low)) if near else None
        if m and tolerance is not None and abs(m[0] - t) > tolerance:
            m = None
        want.append((k, t, i, v, *(m or (None, None, None))))
    assert got.columns == ["k", "t", "id", "v", "t_of", "other", "value"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_segments_of_a_hot_line(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.7 else f"l{i % 4}", rng.randrange(48, 60), round(rng.random() * 300, 1), 1.0) for i in range(300)]
    notes = spark.createDataFrame(rows, "score_id string, p int, o double, d double").dropDuplicates(["score_id", "o", "p"])
    want = N.gap_segments(notes, N.Line(["score_id"]), 2.0)
    for size in (4, 100_000):
        got = scans.gap_segments(notes, ["score_id"], 2.0, size).select(want.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_grams(spark):
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.6 else f"k{i % 5}" if i % 11 else None, i, rng.choice("ab"), rng.choice(["x", None])) for i in range(150)]
    got = scans.gram_counts(spark.createDataFrame(rows, "k string, i long, u string, v string"), ["k"], [F.col("i")], ["u", "v"], 3).collect()
    lines = {}
    for k, i, u, v in rows:
        lines.setdefault(k, []).append((i, u, v))
    each = Counter()
    for k, line in lines.items():
        for c, name in ((1, "u"), (2, "v")):
            t = [r[c] for r in sorted(line)]
            for n in (1, 2, 3):
                each.update((name, n, tuple(t[a : a + n]), k) for a in range(len(t) - n + 1))
    total, held, top = Counter(), Counter(), Counter()
    for (s, n, g, _), c in each.items():
        total[s, n, g] += c
        held[s, n, g] += 1
        top[s, n, g] = max(top[s, n, g], c)
    of = Counter()
    for (s, n, g), c in total.items():
        of[s, n, g[:-1]] += c
    want = {(s, n, g): (c, c / of[s, n, g[:-1]], held[s, n, g], top[s, n, g] / c) for (s, n, g), c in total.items()}
    assert {(r.space, r.n, tuple(r.gram)): (r["count"], r.share, r.keys_with, r.largest_share) for r in got} == want and len(got) == len(want)
