"""The table function takes a line as arrays or as rows of single values."""

from __future__ import annotations

from lineweave.operators import segment

ASK = "select * from segment_line(table({lines}) partition by line) order by line, start_q"


def test_arrays_and_rows_give_the_same_segments(spark):
    segment.register(spark)
    onsets = [0.5 * k for k in range(60)]
    cuts = [(t, 0.9 if t % 8 == 0 else 0.1) for t in [*onsets, 30.0]]
    shape = "line string, measure_length double, times array<double>, evidence array<double>, onsets array<double>"
    arrays = [(name, 4.0, [t for t, _ in part], [e for _, e in part], notes) for name, part, notes in (("a", cuts, onsets), ("b", cuts[:20], onsets[:20]), ("b", cuts[20:], onsets[20:]), ("c", [], []))]
    arrays.append(("d", 4.0, None, None, None))
    single = [(name, 4.0, t, e, None) for name in "ab" for t, e in cuts] + [(name, 4.0, None, None, o) for name in "ab" for o in onsets]
    got = spark.sql(ASK, lines=spark.createDataFrame(arrays, shape)).collect()
    want = spark.sql(ASK, lines=spark.createDataFrame(single, "line string, measure_length double, t double, evidence double, onset double")).collect()
    assert got == want and {r["line"] for r in got} == {"a", "b"} and len(got) > 2
