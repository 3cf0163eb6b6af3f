"""Queries over streams and hot keys, with their SQL. Each stream is fed whole tables in several arrivals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.functions.expressions import rounded
from lineweave.operators import catalog as C
from lineweave.operators import moments, scans
from lineweave.plans.catalog_queries import _SCORES, scores, table
from lineweave.plans.note_queries import _SEG
from lineweave.sources.events import UNIT, notes_of
from lineweave.sources.scratch import shared_path, written
from lineweave.streaming import incremental, stateful


def _arrive(rows: DataFrame, path: str) -> DataFrame:
    """Add files to a folder; gives it as a stream."""
    rows.write.mode("append").parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).parquet(path)


def incremental_selection(spark: SparkSession, d: str) -> DataFrame:
    """2.12b: the catalog comes three times, with other attention figures each time; each score is chosen once."""
    path = shared_path(spark, "selection")
    chosen = "score_id long, mxl string, n_views long"
    for views in (0, 1000, 2000):
        catalog = scores(spark, d).where("score_id % 3 <= 1" if views == 0 else "true").withColumn("n_views", F.col("n_views") + views)
        arrivals = _arrive(catalog, f"{path}/in")
        query = incremental.select_arrivals(arrivals, lambda new, done: C.subset(new, "safe_deduplicated", "mxl"), "score_id", chosen, f"{path}/out", f"{path}/checkpoint", [F.col("n_views")])
        query.awaitTermination()
    return incremental.taken(spark, f"{path}/out", chosen)


def live_phrases(spark: SparkSession, d: str) -> DataFrame:
    """2.12c: notes come in four ranges of time, the last a heartbeat that ends all phrases."""
    path = shared_path(spark, "phrases")
    # written once, as each arrival would derive all notes anew
    notes = written(notes_of(table(spark, d, "events")).select("score_id", F.timestamp_micros("us").alias("t"), "o", "p", "d", "us"), "notes")
    low, high = notes.agg(F.min("us"), F.max("us")).first()  # two numbers
    step = (high - low) // 3 + 1 if low is not None else 1
    for k in range(4):
        part = notes.where(F.floor((F.col("us") - (low or 0)) / step) == k)
        if k == 3:
            part = spark.range(1).select(F.lit(None).cast("long").alias("score_id"), F.timestamp_micros(F.lit((high or 0) + 10**15)).alias("t"), *[F.lit(None).cast(t).alias(c) for c, t in (("o", "double"), ("p", "int"), ("d", "double"), ("us", "long"))])
        stateful.write_live_phrases(_arrive(part, f"{path}/in"), "score_id", f"{path}/out", f"{path}/checkpoint", beat_ms=UNIT / 1000).awaitTermination()
    made = spark.read.schema("score_id long, phrase long, start_q double, end_q double, n_notes long").parquet(f"{path}/out")
    return made.select("score_id", "phrase", rounded(F.col("start_q")).alias("start_q"), rounded(F.col("end_q")).alias("end_q"), "n_notes")


def live_votes(spark: SparkSession, d: str) -> DataFrame:
    """2.12a: votes in three arrivals, the earlier ones last; a trial's earliest vote counts."""
    path = shared_path(spark, "votes")
    votes = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").select(
        (F.col("doc_id") % 97).alias("trial"), F.concat_ws(":", F.lit("t"), F.lpad((F.col("doc_id") % 1000).cast("string"), 4, "0")).alias("at"), F.col("doc_id").alias("ordinal"), "source",
        (F.col("quality") == 1).alias("won"), (F.col("toxic") == 1).alias("tie"), (F.col("doc_id") % 19 == 0).alias("both_poor"))
    for k in (2, 1, 0):
        stateful.write_vote_counts(_arrive(votes.where(F.col("ordinal") % 3 == k), f"{path}/in"), ["trial"], ["source"], "at", "ordinal", f"{path}/out", f"{path}/checkpoint").awaitTermination()
    got = stateful.live_vote_summary(spark, f"{path}/out", {"source": "string"})
    return got.select("source", "votes", "wins", "losses", "ties", "both_poor", "decisive", F.round("win_share", 9).alias("win_share"), "status")


def as_of_tolerance(spark: SparkSession, d: str) -> DataFrame:
    """The last view within two days before each purchase, where one key holds half of all events."""
    e = table(spark, d, "events").select(F.when(F.col("event_id") % 2 == 0, F.lit(0)).otherwise(F.col("user_id")).alias("line"), "event_id", "event_type", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("us"))
    left = e.where("event_type = 'purchase'").select("line", "event_id", "us")
    right = e.where("event_type = 'view'").select("line", "us", F.col("event_id").alias("view_id"))
    return scans.as_of(left, right, ["line"], "us", ["view_id"], F.lit(2 * 86_400_000_000)).select("event_id", "us_of", "view_id")


def projected_variances(spark: SparkSession, d: str) -> DataFrame:
    """V2f, V2g, K7: a scaler and projection that was saved and loaded, applied to all rows: the variance that it keeps."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    path = shared_path(spark, "projection")
    moments.fit(rows, "embedding", 1 << 16).save(spark, path)
    made = moments.load(spark, path).apply(rows, "vec_id", "embedding")
    squares = F.aggregate("components", F.lit(0.0), lambda a, x: a + x * x)
    return made.agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg(squares), 6).alias("variance"), F.max(F.size("components")).alias("components"))


def collapse_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Whether the embeddings have collapsed, over all rows and hashed random pairs."""
    got = moments.collapse(table(spark, d, "embeddings"), "vec_id", "embedding", "label")
    return got.select("rows", *[F.round(c, 6).alias(c) for c in got.columns[1:-1]], "collapsed")


QUERIES = {f.__name__: f for f in (projected_variances, collapse_diagnostics, incremental_selection, live_phrases, live_votes, as_of_tolerance)}

ORACLE = {
    # a scaled component has variance 1, one without spread 0; an orthonormal projection onto all components keeps their sum
    "projected_variances": """with x as (select vec_id, unnest(embedding::double[]) as x, unnest(range(1, len(embedding) + 1)) as i from embeddings), s as (select i, stddev_pop(x) > 1e-12 as spread from x group by 1)
      select (select count(*) from embeddings) as rows, round(count(*) filter (spread)::double, 6) as variance, count(*)::int as components from s""",
    "collapse_diagnostics": """with v as (select vec_id, label, embedding::double[] as e, sqrt(list_dot_product(embedding::double[], embedding::double[])) as norm from embeddings),
      x as (select vec_id, unnest(e) as x, unnest(range(1, len(e) + 1)) as i from v), s as (select stddev_pop(x) as sd from x group by i),
      c as (select a.i as i, b.i as j, avg(a.x * b.x) - avg(a.x) * avg(b.x) as c from x a join x b using (vec_id) group by all),
      p as (select list_dot_product(e, lead(e) over w) / norm / lead(norm) over w as cosine, label is not distinct from lead(label) over w as same from v window w as (order by sha1('42|' || vec_id), vec_id)),
      q as (select * from p where cosine is not null)
      select (select count(*) from v) as rows, round((select avg(norm) from v), 6) as mean_norm, round((select min(sd) from s), 6) as least_std, round((select avg(sd) from s), 6) as mean_std, round((select max(sd) from s), 6) as largest_std,
        round((select pow(sum(c) filter (i = j), 2) / sum(c * c) from c), 6) as effective_rank, round(avg(cosine), 6) as random_cosine, round(avg(cosine) filter (not same), 6) as negative_cosine,
        round(quantile_cont(cosine, 0.05), 6) as q05, round(quantile_cont(cosine, 0.5), 6) as q50, round(quantile_cont(cosine, 0.95), 6) as q95, (select avg(sd) from s) < 1e-3 or avg(cosine) > 0.9 as collapsed from q""",
    "incremental_selection": f"with {_SCORES} select score_id, mxl, (score_id % 1000 + case when score_id % 3 <= 1 then 0 else 1000 end)::bigint as n_views, (case when score_id % 3 <= 1 then 0 else 1 end)::bigint as epoch from scores where lic and dedup and mxl <> ''",
    "live_phrases": f"with {_SEG} select score_id, segment as phrase, round(min(o), 6) as start_q, round(max(o + d), 6) as end_q, count(*) as n_notes from s group by all",
    "live_votes": """with v as (select doc_id % 97 as trial, 't:' || lpad((doc_id % 1000)::varchar, 4, '0') as at0, doc_id as ordinal, source, quality = 1 as won, toxic = 1 as tie, doc_id % 19 = 0 as poor from labels join documents using (doc_id)),
      f as (select * from (select *, row_number() over (partition by trial order by at0, ordinal) as k from v) where k = 1),
      n as (select source, count(*) as votes, count(*) filter (not coalesce(tie, false) and not poor and coalesce(won, false)) as wins, count(*) filter (not coalesce(tie, false) and not poor and not coalesce(won, false)) as losses,
        count(*) filter (coalesce(tie, false)) as ties, count(*) filter (poor) as both_poor from f group by 1)
      select source, votes, wins, losses, ties, both_poor, wins + losses as decisive, round(case when wins + losses > 0 then wins / (wins + losses) else 0.0 end, 9) as win_share, 'inconclusive' as status from n""",
    "as_of_tolerance": """with e as (select case when event_id % 2 = 0 then 0 else user_id end as line, event_id, event_type, epoch_us(ts) as us from events),
      p as (select * from e where event_type = 'purchase'), v as (select line, us, max(event_id) as view_id from e where event_type = 'view' group by all),
      a as (select p.event_id, v.us as us_of, v.view_id, p.us from p asof left join v on p.line = v.line and p.us >= v.us)
      select event_id, case when us - us_of <= 172800000000 then us_of end as us_of, case when us - us_of <= 172800000000 then view_id end as view_id from a""",
}
