"""Streams with state against the batch operators on the same rows, in any batches; late notes, replays, arrivals."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lineweave.operators import notes as N
from lineweave.operators import reviews
from lineweave.streaming import incremental, stateful

NOTES = "line string, t timestamp, o double, p int, d double"


def arrive(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def note(spark_time, line, o, p=60, d=1.0):
    from datetime import datetime, timedelta

    return (line, datetime(2024, 1, 1) + timedelta(seconds=o if spark_time is None else spark_time), o, p, d)


def phrases(spark, tmp_path, batches, **how):
    for rows in batches:
        q = stateful.write_live_phrases(arrive(spark, rows, NOTES, str(tmp_path / "in")), "line", str(tmp_path / "out"), str(tmp_path / "ck"), **how)
        q.awaitTermination()
    return sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))


def want(spark, rows):
    cut = N.gap_segments(spark.createDataFrame(rows, NOTES), N.Line(["line"]), 2.0).groupBy("line", "segment").agg(F.min("o"), F.max(F.col("o") + F.col("d")), F.count("*"))
    return sorted(map(tuple, cut.collect()))


def test_live_phrases_in_any_batches(spark, tmp_path):
    rng = random.Random(3)
    rows = [note(None, rng.choice(["hot", "hot", "a", "b"]), round(rng.random() * 200, 1), rng.randrange(50, 60), rng.choice([0.5, 1.0, 3.0])) for _ in range(150)]
    rows = list({(r[0], r[2], r[3]): r for r in rows}.values())
    end = note(10_000, None, None, None, None)
    # each batch holds notes up to 20 s apart from those of its neighbours, which `late` covers
    late = sorted(rows, key=lambda r: r[2] + rng.random() * 18)
    cuts = [late[:40], late[40:41], late[41:100], late[100:], [end]]
    assert phrases(spark, tmp_path, cuts, late="20 seconds") == want(spark, rows)


def test_late_notes_and_open_phrases(spark, tmp_path):
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    first = [note(None, "a", 0.0), note(None, "a", 1.5), note(None, "a", 10.0), note(None, "b", 11.0)]
    # the watermark is at 11: the phrase at 0 is over, those at 10 and 11 are not
    assert phrases(spark, tmp_path, [first]) == [("a", 0, 0.0, 2.5, 2)]
    # a note at 2 comes too late and is left out; one at 12 goes on
    assert phrases(spark, tmp_path, [[note(None, "a", 2.0), note(None, "a", 12.0)], [note(50, None, None, None, None)]]) == [("a", 0, 0.0, 2.5, 2), ("a", 1, 10.0, 13.0, 2), ("b", 0, 11.0, 12.0, 1)]
    assert spark.conf.get(setting, None) == before  # the session's own setting is back
    # later phrases of a line go on counting
    assert phrases(spark, tmp_path, [[note(None, "a", 60.0)], [note(90, None, None, None, None)]])[2] == ("a", 2, 60.0, 61.0, 1)


VOTES = "run string, query long, at string, ordinal long, source string, won boolean, tie boolean, both_poor boolean"


def test_vote_counts_by_changes(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice(["r1", "r2"]), rng.randrange(25), rng.choice([None, f"2024-01-{rng.randrange(10, 30)}"]), i, rng.choice(["s", "t", None]), rng.choice([True, False, None]), rng.random() < 0.2, rng.choice([True, None, False, False])) for i in range(240)]
    rng.shuffle(rows)
    got, path = None, str(tmp_path / "out")
    for k, part in enumerate((rows[:120], rows[120:121], rows[121:200], rows[200:])):
        stateful.write_vote_counts(arrive(spark, part, VOTES, str(tmp_path / "in")), ["run", "query"], ["source"], "at", "ordinal", path, str(tmp_path / "ck")).awaitTermination()
        seen = rows[: (120, 121, 200, 240)[k]]
        first = reviews.earliest(spark.createDataFrame(seen, VOTES), ["run", "query"], "at", "ordinal")
        got = sorted(map(str, stateful.live_vote_summary(spark, path, {"source": "string"}).collect()))
        assert got == sorted(map(str, reviews.vote_summary(first, ["source"]).collect()))
    changes = spark.read.parquet(path)
    assert changes.where("epoch = 1").agg(F.sum(F.abs("votes"))).first()[0] in (None, 0, 1, 2)  # one vote changes two groups at most
    # a replayed batch starts from the state before it
    for p in (tmp_path / "ck" / "commits").glob("*3*"):
        p.unlink()
    stateful.write_vote_counts(spark.readStream.schema(VOTES).parquet(str(tmp_path / "in")), ["run", "query"], ["source"], "at", "ordinal", path, str(tmp_path / "ck")).awaitTermination()
    assert sorted(map(str, stateful.live_vote_summary(spark, path, {"source": "string"}).collect())) == got


def test_arrivals(spark, tmp_path):
    shape, out = "k long, v string", str(tmp_path / "out")
    run = lambda rows, **how: incremental.select_arrivals(arrive(spark, rows, shape, str(tmp_path / "in")), lambda new, done: new.where("v <> 'no'"), "k", shape, out, str(tmp_path / "ck"), **how).awaitTermination()
    rows = lambda: sorted((r.k, r.v, r.epoch) for r in incremental.taken(spark, out, shape).collect())
    run([(1, "b"), (1, "a"), (2, "no"), (None, "x"), (3, "c")])
    assert rows() == [(1, "a", 0), (3, "c", 0)]
    run([(1, "z"), (2, "yes"), (4, "no")])
    assert rows() == [(1, "a", 0), (2, "yes", 1), (3, "c", 0)]  # what was left out may come again
    run([(1, "again")], force=True)
    assert (1, "again", 2) in rows()
    run([])
    assert len(rows()) == 4
