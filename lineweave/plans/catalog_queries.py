"""Queries over the catalog-like tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.functions import expressions as X
from lineweave.operators import catalog as C
from lineweave.operators import sequences


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as a catalog: flags from status and key, a path that is empty for some, attention figures."""
    o = table(spark, sf_dir, "orders")
    word = F.expr("case o_orderkey % 6 when 0 then 'TRUE' when 1 then 'Yes' when 2 then '0' when 3 then null when 4 then ' t' else 'y' end")
    raw = o.select(
        F.col("o_orderkey").alias("score_id"),
        F.when(F.col("o_orderstatus") != "P", "True").otherwise("false").alias("subset:no_license_conflict"),
        word.alias("subset:deduplicated"),
        F.expr("case when o_orderkey % 11 = 0 then '' when o_orderkey % 13 = 0 then null else concat('mxl/', o_orderkey, '.mxl') end").alias("mxl"),
        F.expr("case when o_orderkey % 7 = 0 then 'n/a' else cast(round(o_totalprice / 100000, 3) as string) end").alias("rating"),
        (F.col("o_orderkey") % 1000).alias("n_views"),
        (F.col("o_orderkey") % 50).alias("n_favorites"),
        (F.col("o_orderkey") % 20).alias("n_ratings"),
        "o_custkey",
        "o_orderpriority",
    )
    return C.normalized(raw)


_SCORES = """scores as (select o_orderkey as score_id, o_orderstatus <> 'P' as lic,
  coalesce(lower(case o_orderkey % 6 when 0 then 'TRUE' when 1 then 'Yes' when 2 then '0' when 3 then null when 4 then ' t' else 'y' end) in ('1','true','t','yes','y'), false) as dedup,
  case when o_orderkey % 11 = 0 then '' when o_orderkey % 13 = 0 then null else 'mxl/' || o_orderkey || '.mxl' end as mxl,
  (case when o_orderkey % 7 = 0 then 0 else round(o_totalprice / 100000, 3) end) + (o_orderkey % 1000) * 0.001::double + (o_orderkey % 50) * 0.01::double + (o_orderkey % 20) * 0.1::double as q,
  o_custkey, o_orderpriority from orders)"""


def _quality():
    return X.quality(F.col("rating"), F.col("n_views"), F.col("n_favorites"), F.col("n_ratings"))


def catalog_flags(spark, d):
    s = scores(spark, d)
    return s.groupBy(F.col("`subset:no_license_conflict`").alias("lic"), F.col("`subset:deduplicated`").alias("dedup")).agg(F.count(F.lit(1)).alias("n"))


def subset_filter(spark, d):
    return C.subset(scores(spark, d), "safe_deduplicated", "mxl").select("score_id", "mxl", X.path_id(F.col("mxl")).alias("path_id"))


def quality_topn(spark, d):
    s = C.subset(scores(spark, d), "no_license_conflict", "mxl").withColumn("q", F.round(_quality(), 6))
    return C.sampled(s, "quality", 100, "score_id", F.col("q")).select("score_id", "q")


def select_random(spark, d):
    return C.sampled(C.subset(scores(spark, d), "safe_deduplicated", "mxl"), "random", 200, "score_id", seed=42).select("score_id", "mxl")


def select_first(spark, d):
    return C.sampled(C.subset(scores(spark, d), "safe_deduplicated", "mxl"), "first", 50, "score_id").select("score_id", "mxl")


def point_lookup(spark, d):
    return C.one(table(spark, d, "part"), "p_partkey", 77).select("p_partkey", "p_name", "p_brand")


def score_drilldown(spark, d):
    return C.drill_down(table(spark, d, "orders"), "o_custkey", 7, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("total"))


def metadata_search(spark, d):
    return C.search(table(spark, d, "part"), {"p_name": "[aeiou]r", "p_type": "^(small|large).*", "p_brand": None}).select("p_partkey", "p_name", "p_type")


def license_mode_filter(spark, d):
    s = scores(spark, d)
    return s.where(F.col("`subset:no_license_conflict`") & (F.col("o_orderpriority") == "1-URGENT")).select("score_id", "o_custkey")


def documents_checked(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    reason = C.first_reason([
        (F.col("text").isNull() | (F.length("text") == 0), "malformed"),
        (F.col("lang").isNull(), "invalid_schema"),
        (F.col("n_chars") < 100, "too_few"),
        (F.col("n_chars") > 5000, "too_many"),
        (F.col("quality").isNull(), "unlabelled"),
        (F.col("toxic") == 1, "toxic"),
    ])
    return docs.withColumn("reason", reason)


def reject_reasons(spark, d):
    return documents_checked(spark, d).where("reason is not null").select("doc_id", "reason")


def eligible_documents(spark, d):
    return documents_checked(spark, d).where("reason is null").select("doc_id", "lang", "source")


def between_filter(spark, d):
    return table(spark, d, "part").where(F.col("p_size").between(10, 20) & F.col("p_retailprice").between(900.0, 1500.0)).select("p_partkey", "p_size", "p_retailprice")


def filter_counts(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return C.counts_per_filter(docs, {
        "labelled": F.col("quality").isNotNull(), "good": F.col("quality") == 1, "clean": F.col("toxic") == 0,
        "length": F.col("n_chars").between(200, 5000), "english": F.col("lang") == "en",
    })


def dedup_keep_first(spark, d):
    rows = C.first_per_key(table(spark, d, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")])
    return rows.select("user_id", "event_type", "event_id")


def display_columns(spark, d):
    s = table(spark, d, "embeddings")
    v = F.col("vec_id")
    found = s.select(v.alias("segment_id"), (v % 50).alias("score_id"), X.token_name("M", F.col("label")).alias("instrument_name"), F.when(v % 3 != 0, F.concat(F.lit("t"), v.cast("string"))).alias("title"),
        F.when(v % 5 != 0, v % 40).alias("start_measure"), (v % 40 + 3).alias("end_measure"), (v / 7.0).alias("similarity"))
    return C.displayed(found)


def unseen_candidates(spark, d):
    e = table(spark, d, "events")
    seen = e.where("event_type = 'purchase' and event_id % 7 = 0").select("user_id")
    return C.unseen(e.select("user_id").distinct(), seen, "user_id")


def blind_payload(spark, d):
    trials = table(spark, d, "labels").withColumn("winner_backend", F.when(F.col("quality") == 1, "learned").otherwise("handcrafted"))
    side = F.when(F.pmod(F.conv(F.substring(X.hash_order(42, F.col("doc_id")), 1, 8), 16, 10).cast("long"), F.lit(2)) == 0, "A").otherwise("B")
    return C.masked(trials.withColumn("first_side", side), ["winner_backend", "quality", "toxic"])


def completed_skip(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("score_id"))
    done = table(spark, d, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("score_id"))
    return C.unseen(o, done, "score_id")


def semi_join_valid(spark, d):
    c = table(spark, d, "customer")
    return c.join(table(spark, d, "orders").where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


def inner_left_joins(spark, d):
    a = table(spark, d, "documents").select("doc_id", "lang")
    b = table(spark, d, "labels").select("doc_id", "quality")
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), X.token_name("M", F.col("label")).alias("melody_token"))
    return a.join(e, "doc_id", "inner").join(b, "doc_id", "left")


def fixed_queries(spark, d):
    return C.evenly_spaced(table(spark, d, "embeddings").select("vec_id", "label"), [F.col("vec_id")], 37)


def union_tagged(spark, d):
    a = table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))
    return a.unionByName(table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation")))


def distinct_tokens(spark, d):
    return sequences.top_tokens(table(spark, d, "events").withColumn("value", F.round("value", 6)), "event_type", "value", 3)


def hash_split_docs(spark, d):
    return table(spark, d, "documents").select("doc_id", X.hash_split(42, F.col("doc_id"), 0.8, 0.1).alias("split"))


def split_summary(spark, d):
    s = table(spark, d, "documents").withColumn("split", X.hash_split(42, F.col("source"), 0.8, 0.1))
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("segments"), F.countDistinct("source").alias("scores"))


def scalar_functions(spark, d):
    n = F.col("event_id") % 128
    v = F.col("value")
    return table(spark, d, "events").select(
        "event_id",
        F.round(X.frequency(n.cast("double")), 6).alias("hz"),
        F.round(X.seconds(n.cast("double"), 100.0), 6).alias("sec"),
        X.ticks(n / 8.0, 480, 100.0).alias("tick"),
        F.round(F.log1p(F.abs(v)), 6).alias("l1p"),
        X.quantize_signed((n - 64).cast("int"), 48).alias("signed"),
        X.quantize_unit(n / 127.0, 64).alias("unit"),
        F.pmod(n, F.lit(12)).alias("pc"),
        F.round(X.length_penalty(n / 8.0, 1.5, 4.0, 8.0, 12.0), 6).alias("penalty"),
        F.round(X.cadence_strength(n, (n * 7) % 12, (n % 5)), 6).alias("cadence"),
    )


def id_list_checksum(spark, d):
    """a checksum of each label's set of ids that partial sums make up, so that no task sees a label's ids."""
    return X.set_checksum(table(spark, d, "embeddings"), ["label"], F.col("vec_id"))


def json_notes(spark, d):
    """Notes out of JSON text: items without p, o, d or v, or of other types, are dropped; null v is 80; sorted."""
    from lineweave.sources.notes_json import notes_from_json

    e = table(spark, d, "events")
    body = F.expr("""case event_id % 5
      when 0 then concat('[{"p":', 40 + event_id % 30, ',"o":1.5,"d":0.5,"v":null},{"p":60,"o":0,"d":1,"v":90}]')
      when 1 then concat('[{"p":', event_id % 100, ',"o":0.25,"d":2}]')
      when 2 then '{"p":64,"o":2.0,"d":0.5,"v":70}'
      when 3 then 'not json' else null end""")
    notes = notes_from_json(body)
    return e.select("event_id", F.size(notes).alias("n"), F.array_join(F.transform(notes, lambda x: F.format_string("%d/%.3f/%.3f/%d", x.p, x.o, x.d, x.v)), ";").alias("notes"))


def reindex_alignment(spark, d):
    ids = table(spark, d, "documents").select(F.col("doc_id"))
    return C.aligned(ids, table(spark, d, "labels"), "doc_id").select("doc_id", "quality", "toxic")


def map_lookup(spark, d):
    return C.looked_up(table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), table(spark, d, "nation"), "n_nationkey").select("c_custkey", "n_name")


QUERIES = {f.__name__: f for f in (
    catalog_flags, subset_filter, quality_topn, select_random, select_first, point_lookup, score_drilldown, metadata_search, license_mode_filter,
    reject_reasons, eligible_documents, between_filter, filter_counts, dedup_keep_first, display_columns, unseen_candidates, blind_payload, completed_skip,
    semi_join_valid, inner_left_joins, fixed_queries, union_tagged, distinct_tokens, hash_split_docs, split_summary, scalar_functions, id_list_checksum, json_notes,
    reindex_alignment, map_lookup,
)}

_CHECKED = """checked as (select d.doc_id, d.lang, d.source, case when text is null or length(text) = 0 then 'malformed' when lang is null then 'invalid_schema'
  when n_chars < 100 then 'too_few' when n_chars > 5000 then 'too_many' when quality is null then 'unlabelled' when toxic = 1 then 'toxic' end as reason
  from documents d left join labels l using (doc_id))"""
_SPLIT = "case when x < 0.8::double then 'train' when x < 0.8::double + 0.1::double then 'validation' else 'test' end"

ORACLE = {
    "reindex_alignment": "select d.doc_id, l.quality, l.toxic from documents d left join labels l using (doc_id)",
    "map_lookup": "select c_custkey, n_name from customer join nation on n_nationkey = c_nationkey",
    "catalog_flags": f"with {_SCORES} select lic, dedup, count(*) as n from scores group by all",
    "subset_filter": f"with {_SCORES} select score_id, mxl, substr(sha1(mxl), 1, 16) as path_id from scores where lic and dedup and mxl <> ''",
    "quality_topn": f"with {_SCORES} select score_id, round(q, 6) as q from scores where lic and mxl <> '' order by round(q, 6) desc, score_id limit 100",
    "select_random": f"with {_SCORES} select score_id, mxl from scores where lic and dedup and mxl <> '' order by sha1('42|' || score_id), score_id limit 200",
    "select_first": f"with {_SCORES} select score_id, mxl from scores where lic and dedup and mxl <> '' order by score_id limit 50",
    "point_lookup": "select p_partkey, p_name, p_brand from part where p_partkey = 77 limit 1",
    "score_drilldown": "select o_orderkey, o_custkey, round(o_totalprice, 2) as total from orders where o_custkey = 7",
    "metadata_search": "select p_partkey, p_name, p_type from part where regexp_matches(coalesce(p_name, ''), '[aeiou]r', 'i') and regexp_matches(coalesce(p_type, ''), '^(small|large).*', 'i')",
    "license_mode_filter": "select o_orderkey as score_id, o_custkey from orders where o_orderstatus <> 'P' and o_orderpriority = '1-URGENT'",
    "reject_reasons": f"with {_CHECKED} select doc_id, reason from checked where reason is not null",
    "eligible_documents": f"with {_CHECKED} select doc_id, lang, source from checked where reason is null",
    "between_filter": "select p_partkey, p_size, p_retailprice from part where p_size between 10 and 20 and p_retailprice between 900 and 1500",
    "filter_counts": """with j as (select * from documents d left join labels l using (doc_id)),
      a as (select count(*) as total, count_if(quality is not null) as labelled, count_if(quality = 1) as good, count_if(toxic = 0) as clean,
        count_if(n_chars between 200 and 5000) as length, count_if(lang = 'en') as english from j)
      select name, n::bigint as n from (unpivot a on total, labelled, good, clean, length, english into name name value n)""",
    "dedup_keep_first": "select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type order by ts, event_id) as r from events) where r = 1",
    "display_columns": """select vec_id as segment_id, vec_id % 50 as score_id, printf('M_%04d', label) as instrument_name, case when vec_id % 3 <> 0 then 't' || vec_id else '' end as title,
      case when vec_id % 5 <> 0 then (vec_id % 40) || ' - ' || (vec_id % 40 + 3) else (vec_id % 40 + 3)::varchar end as measures, round(vec_id / 7.0::double, 4) as similarity from embeddings""",
    "unseen_candidates": "select distinct user_id from events where user_id not in (select user_id from events where event_type = 'purchase' and event_id % 7 = 0)",
    "blind_payload": "select doc_id, case when ('0x' || substr(sha1('42|' || doc_id), 1, 8))::bigint % 2 = 0 then 'A' else 'B' end as first_side from labels",
    "completed_skip": "select o_orderkey as score_id from orders where o_orderkey not in (select l_orderkey from lineitem where l_linestatus = 'F')",
    "semi_join_valid": "select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'F')",
    "inner_left_joins": "select d.doc_id, d.lang, printf('M_%04d', e.label) as melody_token, l.quality from documents d join embeddings e on e.vec_id = d.doc_id left join labels l on l.doc_id = d.doc_id",
    "fixed_queries": """with r as (select vec_id, label, row_number() over (order by vec_id) - 1 as i, count(*) over () as n from embeddings),
      w as (select distinct floor(i * (n - 1) / 36)::bigint as p from range(37) t(i), (select count(*) as n from embeddings))
      select vec_id, label from r join w on w.p = r.i""",
    "union_tagged": "select 'customer' as kind, c_custkey as id, c_nationkey as nation from customer union all select 'supplier', s_suppkey, s_nationkey from supplier",
    "distinct_tokens": "select event_type, round(max(value), 6) as top from events group by 1 order by 2 desc, 1 limit 3",
    "hash_split_docs": f"select doc_id, {_SPLIT} as split from (select doc_id, ('0x' || substr(sha1('42|' || doc_id), 1, 8))::bigint / 4294967295.0::double as x from documents)",
    "split_summary": f"select {_SPLIT} as split, count(*) as segments, count(distinct source) as scores from (select source, ('0x' || substr(sha1('42|' || source), 1, 8))::bigint / 4294967295.0::double as x from documents) group by 1",
    "scalar_functions": """with e as (select event_id, (event_id % 128) as n, value as v from events),
      c as (select *, n / 8.0::double as b, ((n - n % 5) % 12 + 12) % 12 as pb, (((n * 7) % 12 - n % 5) % 12 + 12) % 12 as pa from e)
      select event_id, round(440.0::double * pow(2.0::double, (n - 69) / 12.0::double), 6) as hz, round(n * 60.0::double / 100.0::double, 6) as sec,
        round_even(n / 8.0::double * 480 * 100.0::double / 60.0::double, 0)::bigint as tick, round(ln(1 + abs(v)), 6) as l1p,
        case when n - 64 < -48 then 2 when n - 64 > 48 then 3 else (n - 64)::int + 52 end as signed,
        (round_even(n / 127.0::double * 63, 0) + 2)::int as unit, n % 12 as pc,
        round(case when b > 12 then 1000.0::double when b < 1.5 then 4.0::double * (1.5::double - b) else 0.12::double * (b - 4) * (b - 4) + 0.25::double * greatest(0, b - 8) * greatest(0, b - 8) end, 6) as penalty,
        case when (pb in (2, 11, 7) and pa = 0) or (pb = 5 and pa = 4) then 1.0::double when pa = 0 then 0.5::double when pa = 7 then 0.3::double else 0.0::double end as cadence from c""",
    "id_list_checksum": """with h as (select label, ('0x' || substr(sha1(vec_id::varchar), 1, 15))::bigint as a, ('0x' || substr(sha1(vec_id::varchar), 16, 8))::bigint as b from embeddings)
      select label, sha1(count(*) || '|' || bit_xor(a) || '|' || sum(b)) as checksum, count(*) as n from h group by label""",
    "json_notes": """select event_id, case event_id % 5 when 0 then 2 when 2 then 1 else 0 end::int as n,
      case event_id % 5 when 0 then '60/0.000/1.000/90;' || (40 + event_id % 30) || '/1.500/0.500/80' when 2 then '64/2.000/0.500/70' else '' end as notes from events""",
}
