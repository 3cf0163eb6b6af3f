from __future__ import annotations

import importlib
import subprocess
import sys
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lineweave import config
from lineweave.operators import vectors
from lineweave.plans import commands
from lineweave.sources import musicxml, tables
from lineweave.streaming import live


def test_config(tmp_path):
    c = config.overridden(config.DEFAULTS, {"catalog.max_scores": 5, "catalog.sampling": None, "new.key": 1})
    assert c["catalog"]["max_scores"] == 5 and c["catalog"]["sampling"] == "random" and config.DEFAULTS["catalog"]["max_scores"] == 10000
    assert c["new"] == {"key": 1} and config.overridden(c, {"seed": 7})["seed"] == 7 and config.overridden(c, {"new.a.b": 2})["new"] == {"key": 1, "a": {"b": 2}}
    p = tmp_path / "c.json"
    p.write_text('{"catalog": {"seed": 3}}')
    assert config.load(str(p))["catalog"]["seed"] == 3 and config.load(str(p))["search"]["neighbors"] == 10
    assert config.canonical({"b": 1, "a": 2}) == config.canonical({"a": 2, "b": 1})


def test_catalog_and_logs(spark, tmp_path):
    (tmp_path / "c.csv").write_text('score_id,mxl,subset:deduplicated\ns1,./mxl/a.mxl,True\ns2,,yes\ns3,"b,c.mxl",0\n')
    got = {r.score_id: (r["subset:deduplicated"], r.mxl_path) for r in tables.catalog(spark, str(tmp_path / "c.csv"), "/data", "score_id string, mxl string, `subset:deduplicated` string").collect()}
    assert got == {"s1": (True, "/data/mxl/a.mxl"), "s2": (True, None), "s3": (False, "/data/b,c.mxl")}
    log = str(tmp_path / "log")
    assert tables.read_log(spark, log, "a int, b string").collect() == []
    for k in range(2):
        tables.write_csv(spark.createDataFrame([(k, "x")], "a int, b string"), log, "append")
    assert sorted(r.a for r in tables.read_log(spark, log, "a int, b string").collect()) == [0, 1]
    done = str(tmp_path / "done")
    scores = spark.createDataFrame([("s1", "a"), ("s2", "b")], "score_id string, mxl_path string")
    assert tables.not_completed(spark, scores, done).count() == 2
    tables.mark_completed(scores.limit(1), done)
    assert [r.score_id for r in tables.not_completed(spark, scores, done).collect()] == ["s2"] and tables.not_completed(spark, scores, done, force=True).count() == 2


def test_manifests(spark, tmp_path):
    for k in (8, 16):
        (tmp_path / f"k{k}").mkdir()
        tables.write_json(spark, {"k": k}, str(tmp_path / f"k{k}" / "manifest.json"))
    got = tables.manifests(spark, str(tmp_path), "manifest.json").collect()
    assert [r.path.rpartition("/")[2] for r in got] == ["k16", "k8"] and tables.read_json(spark, str(tmp_path / "k8" / "manifest.json")) == {"k": 8}
    assert tables.manifests(spark, str(tmp_path / "none"), "manifest.json").collect() == []
    assert tables.checksum({"a": 1, "b": 2}) == tables.checksum({"b": 2, "a": 1})
    assert tables.file_checksums(spark, str(tmp_path / "k8" / "manifest.json")).count() == 1
    out = str(tmp_path / "t")
    tables.write_parquet(spark.range(5).withColumn("k", F.col("id") % 2), out, ["k"])
    assert tables.parquet(spark, out).where("k = 1").count() == 2


XML = """<score-partwise><part-list><score-part id="P1"><part-name>Flute</part-name></score-part>
<score-part id="P2"><part-name>Drums</part-name><midi-instrument id="x"><midi-channel>10</midi-channel></midi-instrument></score-part></part-list>
<part id="P1"><measure number="1"><attributes><divisions>2</divisions></attributes>
<note><pitch><step>C</step><octave>4</octave></pitch><duration>2</duration><voice>1</voice><tie type="start"/></note>
<note><chord/><pitch><step>E</step><octave>4</octave></pitch><duration>2</duration><voice>1</voice></note>
<note><rest/><duration>2</duration></note><backup><duration>4</duration></backup>
<note><pitch><step>F</step><alter>1</alter><octave>3</octave></pitch><duration>4</duration><voice>2</voice></note></measure>
<measure number="2"><note><pitch><step>B</step><octave>4</octave></pitch><duration>1</duration><voice>1</voice></note></measure></part>
<part id="P2"><measure number="1"><note><pitch><step>C</step><octave>2</octave></pitch><duration>1</duration></note></measure></part></score-partwise>"""


def test_scores(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML)
    with zipfile.ZipFile(tmp_path / "b.mxl", "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="s.xml"/></rootfiles></container>')
        z.writestr("s.xml", XML)
    (tmp_path / "c.mxl").write_bytes(b"PK junk")
    got = musicxml.read_scores(spark, str(tmp_path)).collect()
    for name in ("a.xml", "b.mxl"):
        own = [(r.part_id, r.voice_id, r.measure, r.o, r.d, r.p, r.tie, r.percussion) for r in got if r.path.endswith(name)]
        assert own == [("P1", "1", 1, 0.0, 1.0, 60, "start", False), ("P1", "1", 1, 0.0, 1.0, 64, None, False), ("P1", "2", 1, 0.0, 2.0, 54, None, False), ("P1", "1", 2, 2.0, 0.5, 71, None, False), ("P2", None, 1, 0.0, 1.0, 36, None, True)]
    assert [r.error is not None for r in got if r.path.endswith("c.mxl")] == [True]


def test_streams(spark, tmp_path):
    src = tmp_path / "votes"
    src.mkdir()
    head = "timestamp,trial_id,won,tie,both_poor\n"
    (src / "1.csv").write_text(head + "2024-01-01 00:00:00,t1,true,false,false\n2024-01-01 00:01:00,t1,false,false,false\n2024-01-01 00:02:00,t2,true,false,false\n")
    stream = live.votes(spark, str(src), "timestamp string, trial_id string, won boolean, tie boolean, both_poor boolean")
    q = live.earliest_votes(stream, ["trial_id"]).writeStream.format("memory").queryName("earliest").trigger(availableNow=True).start()
    assert q.awaitTermination(120) and sorted(r.trial_id for r in spark.table("earliest").collect()) == ["t1", "t2"]
    notes = tmp_path / "notes"
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(str(notes))
    feed = spark.readStream.schema(spark.read.parquet(str(notes)).schema).parquet(str(notes))
    for name, df in (("sessions", live.live_segments(feed, "user_id", "ts")), ("windows", live.token_counts(feed, "ts", "event_type"))):
        q = df.writeStream.format("memory").queryName(name).outputMode("complete" if name == "windows" else "append").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    batch = live.token_counts(spark.read.parquet(str(notes)), "ts", "event_type")
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, batch.collect()))
    want = {(r.user_id, r.start, r.n_notes) for r in live.live_segments(spark.read.parquet(str(notes)), "user_id", "ts").collect()}
    got = {(r.user_id, r.start, r.n_notes) for r in spark.table("sessions").collect()}
    assert got and got <= want


def test_commands_end_to_end(spark):
    rng = np.random.default_rng(1)
    data = []
    for s in range(6):
        at = 0.0
        for k in range(48):
            at += 2.0 if k % 12 == 0 and k else 0.0
            data.append((f"s{s}", "P1", "v1" if s % 2 else None, False, at, int(60 + rng.integers(0, 12)), 1.0, None, int(at // 4) + 1))
            at += 1.0
    notes = spark.createDataFrame(data, "score_id string, part_id string, voice_id string, percussion boolean, o double, p int, d double, tie string, measure int")
    about = spark.createDataFrame([(f"s{s}", f"title {s}", f"c{s % 2}", True) for s in range(6)], "score_id string, title string, composer_name string, license boolean")
    ph = commands.extract_segments(notes, about).cache()
    assert ph.groupBy("score_id").count().where("count >= 2").count() == 6 and ph.select("segment_id").distinct().count() == ph.count()
    assert commands.extraction_summary(ph).first().scores == 6
    emb = commands.build_embeddings(ph)
    assert {k: len(v.first().embedding) for k, v in emb.items()} == {"melody": 74, "rhythm": 72, "combined": 153}
    some = [r.segment_id for r in ph.orderBy("segment_id").limit(2).collect()]
    assert commands.inspect(ph, emb["combined"], some).groupBy("query_id").count().count() == 2
    keep = commands.eligible_segments(ph.withColumn("extraction_mode", F.lit("explicit_voice")), emb)
    assert 0 < keep.count() <= ph.count()
    with pytest.raises(ValueError, match="eligible"):
        commands.eligible_segments(ph.withColumn("license", F.lit(False)), emb)
    p = commands.prepare_encoder_data(ph)
    assert p["eligible"].count() + p["rejected"].count() == ph.count()
    rows = emb["melody"].select(F.col("segment_id").alias("id"), F.col("embedding").alias("vector")).join(ph.select(F.col("segment_id").alias("id"), "score_id", F.col("n_bars").alias("bars")), "id")
    assert commands.evaluate_backends({"a": rows, "b": rows}, 4, 3).groupBy("backend").count().count() == 2
    books = commands.build_vocabulary(rows, [2, 4])
    cmp = commands.compare_vocabulary_sizes({k: b["assignments"] for k, b in books.items()})
    assert cmp["sizes"].where("best").count() == 1 and cmp["steps"].agg(F.sum("overlap")).first()[0] == rows.count()
    tok = {k: b["assignments"].select(F.col("id").alias("segment_id"), "token") for k, b in books.items()}
    desc = ph.select("segment_id", "score_id", "part_id", F.col("line_id").alias("voice_id"), "start_q", "end_q", "composer_name")
    ex = commands.export_tokens(tok[4], tok[2], tok[2], desc)
    assert ex["tokens"].count() == rows.count() and all(abs(r[0] - 1) < 1e-9 for r in ex["melody_transitions"].groupBy("t1").agg(F.sum("p")).select("sum(p)").collect())
    rep = commands.vocabulary_report(books[4]["assignments"])
    assert rep["nearest"].count() == 3 and rep["cosine"].agg(F.sum("n")).first()[0] == rows.count()
    learned = commands.build_learned_index(p["eligible"].select("segment_id", "score_id", "tokens"), lambda x: [[len(t), 1.0] for t in x])
    assert learned.count() == p["eligible"].count()
    pairs = commands.mine_encoder_positives(rows.join(desc.select(F.col("segment_id").alias("id"), "part_id", "start_q", "end_q"), "id").withColumn("split", F.lit("train")), 0.0)
    assert vectors.symmetric(pairs).count() > 0


def own_queries():
    return [n for m in entry._MODULES for n in importlib.import_module(m).QUERIES]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", own_queries())
def test_query_equals_its_sql(spark, duck, name):
    import verify

    df = entry.queries()[name](spark, "/root/testdata/sf0.001")
    got = verify.rows(df.columns, df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got[1]
    else:
        res = duck.execute(sql)
        assert got == verify.rows([d[0] for d in res.description], res.fetchall())


def test_nothing_else_needs_the_llm_package():
    code = "import sys, importlib.util as u; real = u.find_spec; u.find_spec = lambda n, *a: None if n.startswith('lineweave.llm') or n == 'corpus_pipeline' else real(n, *a); import __spark_entry__ as e; assert not any(n.startswith('op') and n[2:3].isdigit() for n in e.queries()) and 'pipeline' not in e.queries() and e.oracle_sql(); assert not any(m.startswith('lineweave.llm') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry.__file__.rpartition("/")[0])


def test_fetched_files_and_records(spark, tmp_path):
    import hashlib

    (tmp_path / "a.bin").write_bytes(b"abc")
    want = spark.createDataFrame([("a.bin", hashlib.md5(b"abc").hexdigest().upper()), ("b.bin", "0"), ], "name string, md5 string")
    assert {(r.name, r.found, r.ok) for r in tables.verified_files(spark, str(tmp_path), want).collect()} == {("a.bin", True, True), ("b.bin", False, False)}
    got = tables.json_records(spark.createDataFrame([(1, float("nan"), [1, 2])], "a int, x double, l array<int>")).first().record
    assert got == '{"a":1,"x":null,"l":[1,2]}'
