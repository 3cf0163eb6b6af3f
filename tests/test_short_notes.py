"""Notes shorter than the tolerance of boundary evidence."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lineweave.operators import notes as N

LINE = N.Line(["score_id"])
SHAPE = "score_id string, o double, p int, d double, measure int"


def test_a_note_shorter_than_the_tolerance_does_not_come_before_itself(spark):
    rows = [("a", 0.0, 60, 1.0, 1), ("a", 1.5, 72, 5e-7, 1), ("a", 1.5 + 5e-7, 62, 1.0, 1), ("a", 6.0, 67, 1.0, 2)]
    got = N.boundary_evidence(spark.createDataFrame(rows, SHAPE), LINE, tonic=F.lit(0)).orderBy("o").collect()
    assert [r.o for r in got] == [1.5, 1.5 + 5e-7, 6.0]
    assert got[0].rest_before == 0.6 and got[0].leap_after == pytest.approx(1.0)  # after the note at 0
    assert got[1].rest_before == 0.0 and got[1].leap_after == pytest.approx(0.8)  # after the short note
    assert got[2].rest_before == 1.0 and got[2].leap_after == pytest.approx(0.3) and got[2].contour_change == 0.0


def test_notes_without_length_at_one_time_follow_each_other(spark):
    rows = [("a", 0.0, 60, 1.0, 1), ("a", 1.0, 70, 0.0, 1), ("a", 1.0, 65, 0.0, 1), ("a", 1.0, 50, 1.0, 1)]
    got = N.boundary_evidence(spark.createDataFrame(rows, SHAPE), LINE, tonic=F.lit(0)).orderBy(F.desc("p")).collect()
    assert [(r.p, round(r.leap_after, 9)) for r in got] == [(70, 0.8), (65, 0.3), (50, 1.0)]
