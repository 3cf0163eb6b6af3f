"""Rounding of halves as SQL does it."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from lineweave.functions.expressions import rounded
from lineweave.plans import note_queries


def test_halves_are_rounded_as_in_sql(spark, tmp_path):
    halves = [(21600 * m + 10800) / 21600000000.0 for m in range(1_000_000, 1_003_000)] + [64.9472225, -64.9472225, 33.1760695, 65.6399915, 0.0]
    df = spark.createDataFrame([(x,) for x in halves], "x double")
    got = df.select("x", rounded(F.col("x")).alias("r")).toPandas()
    assert duckdb.sql("select count(*) from got where r <> round(x, 6)").fetchall()[0][0] == 0
    old = df.select("x", F.round("x", 6).alias("r")).toPandas()
    assert duckdb.sql("select count(*) from old where r <> round(x, 6)").fetchall()[0][0] > 0
    # a line whose second phrase starts at such a half: its name is a hash of the rounded times
    start = 1704067200000000
    us = [start, start + 1402860006000]
    events = spark.createDataFrame([(k, 7, "view", 1.0, '{"k": 5}', u) for k, u in enumerate(us)], "event_id long, user_id long, event_type string, value double, props string, us long")
    events.select("event_id", F.expr("cast(timestamp_micros(us) as timestamp_ntz)").alias("ts"), "user_id", "event_type", "value", "props").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(f"select segment, segment_id from ({note_queries.ORACLE['gap_segments']}) order by 1").fetchall()
    assert [tuple(r) for r in note_queries.gap_segments(spark, str(tmp_path)).orderBy("segment").select("segment", "segment_id").collect()] == want
