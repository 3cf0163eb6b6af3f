"""The jobs over growing copies of the tables, broken runs, their command lines."""

from __future__ import annotations

import json
import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs import ingest_documents, phrase_ngrams
from lineweave.streaming import incremental

DOCS = "doc_id long, text string, lang string, source string"
LONG = "word " * 30


def files(spark, folder, name, rows, schema=DOCS):
    """One Parquet file of its own in folder."""
    aside = folder.parent / f"aside-{name}"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(aside))
    folder.mkdir(exist_ok=True)
    shutil.copy(next(aside.glob("part-*.parquet")), folder / f"{name}.parquet")


def state(spark, out):
    return {r.doc_id: (r.reason, r.epoch) for r in ingest_documents.corpus(spark, str(out)).collect()}


def test_two_runs_over_growing_input(spark, tmp_path):
    arriving, out, mark = tmp_path / "in", tmp_path / "out", str(tmp_path / "mark")
    run = lambda **c: ingest_documents.run(spark, str(arriving), str(out), mark, c)
    files(spark, arriving, "a", [(1, LONG, "en", "s"), (2, LONG, "en", "s"), (3, None, "en", "s"), (4, "", None, "s"), (5, LONG + "x", None, "s"), (6, "short", "en", "s"), (7, "w " * 5001, "en", "s"), (8, LONG + "y", "de", None), (None, LONG, "en", "s")])
    assert run() == {"batches": 1, "added": 8}
    first = {1: (None, 0), 2: ("duplicate", 0), 3: ("malformed", 0), 4: ("malformed", 0), 5: ("no_language", 0), 6: ("too_short", 0), 7: ("too_long", 0), 8: (None, 0)}
    assert state(spark, out) == first
    before = sorted(p.stat().st_mtime_ns for p in (out / "corpus").rglob("*.parquet"))
    assert run() == {"batches": 0, "added": 0} and sorted(p.stat().st_mtime_ns for p in (out / "corpus").rglob("*.parquet")) == before
    # ids known already stay as they are, texts kept earlier are duplicates, whatever their id
    files(spark, arriving, "b", [(1, LONG + "changed", "en", "s"), (0, LONG, "en", "s"), (9, LONG + "z", "fr", "s"), (9, LONG + "zz", "fr", "s"), (10, LONG + "x", "en", "s")])
    assert run() == {"batches": 1, "added": 3}
    assert state(spark, out) == first | {0: ("duplicate", 1), 9: (None, 1), 10: (None, 1)}
    rows = ingest_documents.corpus(spark, str(out))
    assert rows.where("text is not null").count() == rows.where("reason is null").count() == 4 and rows.where("doc_id = 9 and text like '%zz'").count() == 0
    counted = ingest_documents.totals(spark, str(out)).groupBy("lang", "split", "reason").agg(F.sum("documents").alias("n"), F.sum("words").alias("w"))
    assert sorted(map(str, counted.collect())) == sorted(map(str, rows.groupBy("lang", "split", "reason").agg(F.count("*").alias("n"), F.sum(F.col("n_words").cast("long")).alias("w")).collect()))
    assert {p.name for p in (out / "corpus" / "epoch=1").glob("split=*")} <= {"split=train", "split=validation", "split=test", "split=rejected"}


def test_a_broken_run_is_completed(spark, tmp_path, monkeypatch):
    arriving, out, mark = tmp_path / "in", tmp_path / "out", str(tmp_path / "mark")
    files(spark, arriving, "a", [(1, LONG, "en", "s"), (2, LONG + "b", "en", "s")])
    whole = incremental.take

    def broken(*args, **kwargs):  # the files are written, the checkpoint never hears of them
        whole(*args, **kwargs)
        raise OSError("the driver is gone")

    monkeypatch.setattr(incremental, "take", broken)
    with pytest.raises(Exception, match="driver is gone"):
        ingest_documents.run(spark, str(arriving), str(out), mark)
    assert len(state(spark, out)) == 2
    monkeypatch.setattr(incremental, "take", whole)
    files(spark, arriving, "b", [(2, "again " * 30, "en", "s"), (3, LONG, "en", "s")])
    assert ingest_documents.run(spark, str(arriving), str(out), mark) == {"batches": 2, "added": 3}
    assert state(spark, out) == {1: (None, 0), 2: (None, 0), 3: ("duplicate", 1)}
    # the checkpoint forgets the last epoch: it is replayed with the same result
    want = state(spark, out)
    os.remove(f"{mark}/commits/1")
    for p in (tmp_path / "mark" / "commits").glob(".1*"):
        p.unlink()
    assert ingest_documents.run(spark, str(arriving), str(out), mark)["batches"] == 1 and state(spark, out) == want
    with pytest.raises(ValueError, match="another checkpoint"):
        ingest_documents.run(spark, str(arriving), str(out), str(tmp_path / "new"))


def test_many_batches(spark, tmp_path):
    arriving, out = tmp_path / "in", tmp_path / "out"
    for k in range(4):
        files(spark, arriving, f"f{k}", [(i, LONG + str(i), "en", "s") for i in range(k, k + 3)])
    assert ingest_documents.run(spark, str(arriving), str(out), str(tmp_path / "mark"), {"max_files_per_trigger": 1}) == {"batches": 4, "added": 6}
    assert sorted(state(spark, out)) == list(range(6)) and {r.reason for r in ingest_documents.corpus(spark, str(out)).collect()} == {None}
    with pytest.raises(ValueError, match="unknown settings"):
        ingest_documents.run(spark, str(arriving), str(out), str(tmp_path / "mark"), {"least": 1})


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark, path, n=400):
    rows = spark.range(n).selectExpr(
        "id as event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(id * 5 + id % 7 * 11 as int)) as ts", "if(id % 3 = 0, 0, id % 8) as user_id", "'view' as event_type", "1.0 as value", "concat('{\"k\": ', id * 17 % 53, '}') as props")
    rows.unionByName(spark.createDataFrame([(n, None, 1, "view", 1.0, '{"k": 1}'), (n + 1, None, None, None, None, "no json")], EVENTS).withColumn("ts", F.col("ts").cast("timestamp_ntz"))).write.mode("overwrite").parquet(path)


def test_phrases_rerun_to_the_same(spark, tmp_path):
    path, out = str(tmp_path / "events"), str(tmp_path / "out")
    events(spark, path)
    made = phrase_ngrams.run(spark, path, out)
    rows = {n: sorted(map(str, t.collect())) for n, t in phrase_ngrams.tables(spark, out).items()}
    assert phrase_ngrams.run(spark, path, out) == made and {n: sorted(map(str, t.collect())) for n, t in phrase_ngrams.tables(spark, out).items()} == rows
    assert made["phrases"] > 20 and made["grams"] > made["phrases"] / 4
    # phrases don't depend on how many notes a block holds
    small = phrase_ngrams.phrases(phrase_ngrams.notes_of(spark.read.parquet(path), 5), phrase_ngrams.CONFIG, 5)
    assert sorted(map(str, small.select(*phrase_ngrams.tables(spark, out)["phrases"].columns).collect())) == rows["phrases"]
    unigrams = phrase_ngrams.tables(spark, out)["grams"].where("n = 1 and space = 'melody'").agg(F.sum("count"), F.round(F.sum("share"), 6)).first()
    assert tuple(unigrams) == (made["phrases"], 1.0)
    events(spark, path, 0)
    assert phrase_ngrams.run(spark, path, out) == {"phrases": 0, "grams": 0}


@pytest.mark.parametrize("job", ["ingest_documents", "phrase_ngrams"])
def test_command_lines(spark, tmp_path, job):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    module = {"ingest_documents": ingest_documents, "phrase_ngrams": phrase_ngrams}[job]
    with open(f"{root}/jobs/{job}.json", encoding="utf-8") as f:
        assert json.load(f) == module.CONFIG
    if job == "ingest_documents":
        files(spark, tmp_path / "in", "a", [(1, LONG, "en", "s")])
        args = ["--documents", str(tmp_path / "in"), "--checkpoint", str(tmp_path / "mark")]
    else:
        events(spark, str(tmp_path / "in"))
        args = ["--events", str(tmp_path / "in")]
    done = subprocess.run([sys.executable, "-m", f"jobs.{job}", *args, "--output", str(tmp_path / "out"), "--config", f"{root}/jobs/{job}.json"], cwd=root, capture_output=True, text=True, timeout=300, check=False)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "to " + str(tmp_path / "out") in done.stderr and list((tmp_path / "out").rglob("*.parquet"))
