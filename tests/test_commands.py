"""Evaluation commands, backends, run names and the table function."""

from __future__ import annotations

import datetime
import re

import numpy as np
from pyspark.sql import functions as F

from lineweave.functions.expressions import run_id, utc_now
from lineweave.operators import ann, backends, vectors
from lineweave.plans import commands, vector_queries
from lineweave.sources import tables

SF = "/root/testdata/sf0.001"


def test_table_function_equals_the_fold(spark):
    a, b = vector_queries.segmented_lines(spark, SF).collect(), vector_queries.segmented_in_sql(spark, SF).collect()
    assert a and sorted(map(tuple, a)) == sorted(map(tuple, b))


def embedded(spark, n=60):
    rng = np.random.default_rng(6)
    c = rng.normal(size=(n // 2, 8))
    return spark.createDataFrame([(k, k % 5, (c[k // 2] + rng.normal(size=8) * 0.05).tolist()) for k in range(n)], "id long, score_id long, vector array<double>")


def test_encoder_and_vocabulary_evaluation(spark):
    rows = embedded(spark)
    pairs = spark.createDataFrame([(2 * k, 2 * k + 1) for k in range(10)] + [(500, 501)], "id_a long, id_b long")
    made = commands.evaluate_encoder(rows, pairs)
    r = made["retrieval"].first()
    assert (r.queries, r.pairs, r.recall_1) == (20, 10, 1.0) and r.positive_cosine > 0.95 and not made["collapse"].first().collapsed
    assigned = vectors.assign(rows, [(i, rows.where(f"id = {7 * i}").first().vector) for i in range(4)], "id", "vector")
    got = commands.evaluate_vocabulary(rows, assigned, queries=7, n=3)
    assert got["queries"].count() == 7 == got["means"].first().queries
    ratings = spark.createDataFrame([(f"t{k % 45}", f"2024-01-0{1 + k // 45}", "coherent" if k < 40 else "mixed", k) for k in range(90)], "token string, timestamp string, rating string, ordinal long")
    trials = spark.createDataFrame([(f"x{k}", "2024", True, False, False, k) for k in range(60)], "trial_id string, timestamp string, same_cluster_won boolean, tie boolean, neither boolean, ordinal long")
    s = commands.summarize_vocabulary_evaluation(ratings, trials)
    assert (s["reviews"].first().reviewed, s["reviews"].first().coherent, s["combined"].first().status) == (45, 40, "pass")


def test_backends(spark, tmp_path):
    rows = embedded(spark)
    index = ann.build(rows.select("id", "vector"), str(tmp_path / "runs/20240101T000000Z_abcdef12/retrieval"), cell=10)
    both = backends.compared([backends.Exact("exact", rows, {"other_score": False}), backends.Indexed("index", index)], rows.where("id < 5"), 1)
    assert {(r.backend, r.query_id, r.id) for r in both.collect()} == {(b, q, q ^ 1) for b in ("exact", "index") for q in range(5)}
    (tmp_path / "runs/20230101T000000Z_00000000").mkdir()
    assert tables.indexed_runs(spark, str(tmp_path / "runs")) == ["20240101T000000Z_abcdef12"] and tables.indexed_runs(spark, str(tmp_path / "none")) == []


def test_names_of_runs(spark):
    at = spark.range(1).select(run_id(F.lit("2024-03-05 06:07:08").cast("timestamp"), F.lit("0123456789")).alias("r"), utc_now().alias("now")).first()
    assert at.r == "20240305T060708Z_01234567" and re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", at.now)
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        now = spark.range(1).select(utc_now()).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert abs(datetime.datetime.strptime(now, "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=datetime.UTC).timestamp() - datetime.datetime.now(datetime.UTC).timestamp()) < 60
