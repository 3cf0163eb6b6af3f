from __future__ import annotations

import hashlib
import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lineweave.functions import expressions as X
from lineweave.sources.notes_json import notes_from_json


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_boolize(spark):
    rows = [("1",), ("TRUE",), ("t",), ("Yes",), ("y",), ("0",), (" true",), ("1.0",), (None,), ("no",)]
    got = [r[0] for r in spark.createDataFrame(rows, "v string").select(X.boolize(F.col("v"))).collect()]
    assert got == [True] * 5 + [False] * 5


def test_quality_and_numbers(spark):
    r = one(spark, X.quality(F.lit("4.5"), F.lit(1000), F.lit("x"), F.lit(None)))
    assert abs(r[0] - 5.5) < 1e-12


def test_hashes(spark):
    r = one(spark, X.path_id(F.lit("a/b.mxl")), X.segment_id(F.lit("s"), F.lit("p"), F.lit("v"), F.lit(1.0), F.lit(2.5)), X.unit_hash(42, F.lit("k")))
    assert r[0] == hashlib.sha1(b"a/b.mxl").hexdigest()[:16]
    assert r[1] == hashlib.sha1(b"s|p|v|1.000000|2.500000").hexdigest()[:16]
    assert r[2] == int(hashlib.sha1(b"42|k").hexdigest()[:8], 16) / 0xFFFFFFFF


def test_wilson_vector(spark):
    low, high = X.wilson(F.lit(3), F.lit(25))
    r = one(spark, low, high, *X.wilson(F.lit(0), F.lit(0)))
    assert abs(r[0] - 0.04166741357068093) < 1e-9 and abs(r[1] - 0.2995619218337349) < 1e-9 and (r[2], r[3]) == (0.0, 0.0)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 80), st.integers(0, 80)), min_size=1, max_size=20))
def test_wilson_is_ordered(spark, pairs):
    rows = [(min(a, b), max(a, b)) for a, b in pairs]
    low, high = X.wilson(F.col("w"), F.col("n"))
    for lo, hi in spark.createDataFrame(rows, "w long, n long").select(low, high).collect():
        assert 0 <= lo <= hi <= 1


def test_quantizers(spark):
    v = [-49, -48, 0, 48, 49]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in v], "v int").select(X.quantize_signed(F.col("v"), 48)).collect()]
    assert got == [2, 4, 52, 100, 3]
    u = [0.0, 0.5, 1.0, 7.0, -1.0, 0.5 / 63 * 3]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in u], "v double").select(X.quantize_unit(F.col("v"), 64)).collect()]
    assert got == [2 + min(max(round(min(max(x, 0), 1) * 63), 0), 63) for x in u]
    assert one(spark, X.quantize_unit(F.lit(0.3), 1))[0] == 2


def test_medians_vectors_and_penalty(spark):
    r = one(spark, X.upper_median(F.array(F.lit(3.0), F.lit(1.0), F.lit(2.0), F.lit(9.0))), X.norm(F.array(F.lit(3.0), F.lit(4.0))), X.length_penalty(F.lit(13.0), 1.5, 4.0, 8.0, 12.0), X.length_penalty(F.lit(1.0), 1.5, 4.0, 8.0, 12.0), X.length_penalty(F.lit(10.0), 1.5, 4.0, 8.0, 12.0))
    assert r[0] == 3.0 and r[1] == 5.0 and r[2] == 1000.0 and r[3] == 2.0 and abs(r[4] - (0.12 * 36 + 0.25 * 4)) < 1e-12
    rows = [([1.0, 0.0],), ([0.0, 0.0],), (None,), ([float("nan"), 1.0],), ([float("inf"), 1.0],), ([None, 1.0],)]
    assert [r[0] for r in spark.createDataFrame(rows, "v array<double>").select(X.valid_vector(F.col("v"))).collect()] == [True] + [False] * 5


def test_cadence(spark):
    rows = [(62, 60), (71, 60), (65, 64), (67, 60), (61, 60), (60, 67), (60, 61), (None, 60)]
    got = [r[0] for r in spark.createDataFrame(rows, "a int, b int").select(X.cadence_strength(F.col("a"), F.col("b"), F.lit(0))).collect()]
    assert got == [1.0, 1.0, 1.0, 1.0, 0.5, 0.3, 0.0, 0.0]


def test_pitch_and_time(spark):
    r = one(spark, X.frequency(F.lit(69.0)), X.frequency(F.lit(81.0)), X.seconds(F.lit(2.0), 120.0), X.token_name("M", F.lit(7)), X.token_name("M", F.lit(12345)))
    assert abs(r[0] - 440) < 1e-9 and abs(r[1] - 880) < 1e-9 and r[2] == 1.0 and r[3] == "M_0007" and r[4] == "M_12345"


def test_notes_of_many_shapes(spark):
    rows = [
        ('[{"p":62,"o":1,"d":0.5,"v":null},{"p":60,"o":0,"d":1,"v":90}]',), ('{"p":64,"o":2.0,"d":0.5,"v":70}',), ("not json",), (None,), ("[]",), ('[{"p":1,"o":2}]',), ('[{"p":"x","o":1,"d":1,"v":1}]',), ('"text"',),
    ]
    got = [[tuple(n) for n in r[0]] for r in spark.createDataFrame(rows, "j string").select(notes_from_json(F.col("j"))).collect()]
    assert got == [[(60, 0.0, 1.0, 90), (62, 1.0, 0.5, 80)], [(64, 2.0, 0.5, 70)], [], [], [], [], [], []]


def test_entropy_term(spark):
    assert abs(one(spark, X.entropy(F.lit(1.0), F.lit(4.0)))[0] - 0.25 * math.log(4)) < 1e-12
