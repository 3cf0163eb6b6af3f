"""Lines, features, tokens and segmentation: properties and brute force."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineweave.operators import features as V
from lineweave.operators import notes as N
from lineweave.operators import segment

LINE = N.Line(["score_id"])
NOTE = "array<struct<p:int,o:double,d:double>>"


def vectors(spark, make, *segments):
    rows = [(k, [(p, float(o), float(d)) for p, o, d in ph]) for k, ph in enumerate(segments)]
    df = spark.createDataFrame(rows, f"k int, notes {NOTE}")
    return [None if r[0] is None else np.array(r[0], float) for r in df.orderBy("k").select(make(F.col("notes"))).collect()]


def cos(a, b):
    return float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))


TUNE = [(60, 0, 1), (62, 1, 1), (64, 2, 1), (67, 3, 1)]


def test_transposition_tempo_and_reversal(spark):
    up = [(p + 7, o, d) for p, o, d in TUNE]
    slow = [(p, o * 1.5, d * 1.5) for p, o, d in TUNE]
    down = [(127 - p, o, d) for p, o, d in TUNE]
    melody = lambda n: F.concat(V.contour(n), V.intervals(n), V.pitch_classes(n))
    a, b = vectors(spark, melody, TUNE, up)
    assert cos(a, b) > 0.98 and len(a) == 74
    a, b = vectors(spark, V.rhythm, TUNE, slow)
    assert cos(a, b) > 0.95 and len(a) == 72
    a, b = vectors(spark, V.contour, TUNE, down)
    assert cos(a, b) < 0.5
    assert all(len(x) == 30 for x in vectors(spark, V.intervals, TUNE, [(60, 0, 1)], []))


def test_contour_is_linear_interpolation(spark):
    rng = random.Random(1)
    segments = []
    for _ in range(10):
        o, ph = 0.0, []
        for _ in range(rng.randrange(1, 9)):
            ph.append((rng.randrange(40, 80), o, rng.choice([0.25, 0.5, 1.0])))
            o += rng.choice([0.25, 0.5, 1.5])
        segments.append(ph)
    for ph, got in zip(segments, vectors(spark, V.contour, *segments), strict=True):
        t, p = [o for _, o, _ in ph], np.array([p for p, _, _ in ph], float)
        want = np.interp(np.linspace(0, max(o + d for _, o, d in ph), 32), t, p - p[0])
        assert np.allclose(got, want)


def test_tokens(spark):
    up = [(p + 5, o * 2, d * 2) for p, o, d in TUNE]
    a, b, none, long = vectors(spark, V.tokens, TUNE, up, [], [(60, k, 1) for k in range(97)])
    assert (a == b).all() and a.shape == (4, 5) and a[0].tolist() == [52, 28, 2, 18, 2] and none.size == 0 and long is None
    (padded,) = vectors(spark, lambda n: V.tokens(n, most=6, pad=True), TUNE)
    assert padded.shape == (6, 5) and (padded[4:] == 0).all()


def test_standardized_is_population_z_with_constant_columns(spark):
    df = spark.createDataFrame([(1, [1.0, 5.0]), (2, [3.0, 5.0])], "id int, v array<double>")
    got = sorted(tuple(r) for r in V.standardized(df, "id", "v").collect())
    assert got == [(1, 0, -1.0), (1, 1, 0.0), (2, 0, 1.0), (2, 1, 0.0)]


def line(spark, rows, columns="score_id string, o double, p int, d double, measure int"):
    return spark.createDataFrame(rows, columns)


def test_ties_and_skyline(spark):
    rows = [("a", 0.0, 60, 1.0, None), ("a", 1.0, 60, 1.0, "stop"), ("a", 2.0, 60, 1.0, "start"), ("a", 4.0, 60, 1.0, "continue"), ("a", 5.0, 62, 1.0, "stop")]
    got = [(r.o, r.p, r.d) for r in N.merged_ties(line(spark, rows, "score_id string, o double, p int, d double, tie string"), LINE).orderBy("o").collect()]
    assert got == [(0.0, 60, 2.0), (2.0, 60, 1.0), (4.0, 60, 1.0), (5.0, 62, 1.0)]
    rows = [("a", 0.0, 60, 1.0, 1), ("a", 0.0, 72, 0.5, 1), ("a", 0.5, 72, 1.0, 1), ("a", 1.5, 71, 1.0, 1), ("a", 3.0, 71, 1.0, 2), ("a", 3.0, 50, 3.0, 2), ("a", 3.5, 71, 0.25, 2)]
    got = [(r.o, r.p, r.d) for r in N.skyline(line(spark, rows), LINE).orderBy("o").collect()]
    assert got == [(0.0, 72, 1.5), (1.5, 71, 1.0), (3.0, 71, 3.0)]


def test_line_policy(spark):
    rows = [("s", "p1", "v1", False, float(k), 60 + k % 5, 1.0, None) for k in range(12)] + [("s", "p1", "v2", False, float(k), 50, 1.0, None) for k in range(3)]
    rows += [("s", "p2", None, False, float(k * 2), 60 + k, 1.0, None) for k in range(12)] + [("s", "p3", None, True, float(k), 40, 1.0, None) for k in range(20)]
    got = N.lines(line(spark, rows, "score_id string, part_id string, voice_id string, percussion boolean, o double, p int, d double, tie string"), ["score_id", "part_id"])
    n = {(r.part_id, r.line_id, r.extraction_mode): r["count"] for r in got.groupBy("part_id", "line_id", "extraction_mode").count().collect()}
    assert n == {("p1", "v1", "explicit_voice"): 12, ("p2", "skyline", "skyline"): 12}


def test_evidence_of_a_rest_and_keys(spark):
    rows = [("a", float(k), 60, 1.0, 1 + k // 4) for k in range(4)] + [("a", 6.0 + k, 67, 1.0, 3) for k in range(4)]
    ev = {r.o: r for r in N.boundary_evidence(line(spark, rows), LINE, tonic=F.lit(0)).collect()}
    assert ev[6.0].rest_before == 1.0 and ev[6.0].metric_strength == 0.5 and abs(ev[6.0].leap_after - 0.5) < 1e-12 and ev[6.0].cadence == 0.3
    assert ev[6.0].evidence == max(r.evidence for r in ev.values())
    scale = [60, 62, 64, 65, 67, 69, 71, 72, 67, 64, 60]
    key = N.key_of(line(spark, [("c", float(k), p, 1.0, 1) for k, p in enumerate(scale)] + [("g", float(k), p + 7, 1.0, 1) for k, p in enumerate(scale)]), LINE)
    assert {(r.score_id, r.tonic, r.mode) for r in key.collect()} == {("c", 0, "major"), ("g", 7, "major")}


def test_best_cuts_against_all_segmentations():
    rng = random.Random(7)
    for _ in range(60):
        n = rng.randrange(3, 9)
        times = sorted(rng.sample(range(1, 30), n - 1))
        times = [0.0, *map(float, times)]
        gain = [rng.random() * 3 for _ in times]
        onsets = sorted(rng.random() * times[-1] for _ in range(25))
        limits = segment.Limits(min_notes=rng.choice([1, 3, 5]))

        def worth(cuts):
            total = 0.0
            for i, j in zip(cuts, cuts[1:], strict=False):
                held = sum(times[i] - 1e-6 <= o < times[j] + 1e-6 for o in onsets)
                if held < limits.min_notes and j != n - 1:
                    return None
                total += gain[j] - float(segment.penalties(np.array([(times[j] - times[i]) / 2.0]), limits)[0]) - (limits.split_penalty if i else 0)
            return total

        options = [w for k in range(n - 1) for mid in itertools.combinations(range(1, n - 1), k) if (w := worth([0, *mid, n - 1])) is not None]
        got = segment.best_cuts(times, gain, onsets, 2.0, limits)
        assert abs(worth(got) - max(options)) < 1e-9


def test_segments_of_a_line(spark):
    rows = [("a", [0.0, 8.0, 16.0], [0.0, 5.0, 0.0], [float(k) for k in range(16)], 2.0), ("b", [0.0, 2.0], [0.0, 0.0], [0.0, 1.0], 2.0)]
    df = spark.createDataFrame(rows, "k string, times array<double>, evidence array<double>, onsets array<double>, measure_length double")
    got = [tuple(r) for r in segment.segment_lines(df, "k").orderBy("start_q").collect()]
    assert got == [("a", 0.0, 8.0, 9, 4.0), ("a", 8.0, 16.0, 8, 4.0)]


def test_measures_medians_candidates(spark):
    rows = [("a", float(k), 60, 1.0, 1 + k // 4) for k in range(8)] + [("one", 0.0, 60, 2.0, None)] + [("flat", float(k), 60, 1.0, 1) for k in range(6)]
    m = {r.score_id: r.measure_length for r in N.measure_length(line(spark, rows), LINE).collect()}
    assert m == {"a": 1.0, "one": 4.0, "flat": 1.5}
    t = {r.t for r in N.candidate_times(line(spark, [("a", 0.0, 60, 1.0, 1), ("a", 1.0, 60, 0.5, 1)]), LINE).collect()}
    assert t == {0.0, 1.0, 1.5}
    d = [0.5, 1.0, 0.25, 2.0, 0.0, 1.0, 4.0, 3.0]
    got = [r.local_median for r in N.local_median(line(spark, [("a", float(k), 60, x, 1) for k, x in enumerate(d)]), LINE).orderBy("o").collect()]
    want = []
    for k in range(len(d)):
        near = sorted(x for x in d[max(0, k - 3) : k + 4] if x > 0)
        want.append(near[len(near) // 2])
    assert got == want


def test_notes_that_still_sound_are_no_previous_notes(spark):
    rows = [("a", 0.0, 60, 4.0, 1), ("a", 1.0, 62, 0.5, 1), ("a", 2.0, 64, 0.5, 1), ("a", 6.0, 59, 1.0, 2)]
    ev = {r.o: r for r in N.boundary_evidence(line(spark, rows), LINE, tonic=F.lit(0)).collect()}
    assert set(ev) == {2.0, 6.0}  # nothing has ended by 1.0
    assert ev[2.0].rest_before == 0.6 and ev[2.0].leap_after == 0.0  # after the note at 1.0
    # at 6.0 three notes have ended; the last of them in line order is that at 2.0, before it that at 1.0
    assert ev[6.0].rest_before == 1.0 and ev[6.0].leap_after == pytest.approx(0.3) and ev[6.0].metric_strength == 0.5
