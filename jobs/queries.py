"""The jobs as queries: each is run twice over the whole tables into a new folder, and its output read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import ingest_documents, phrase_ngrams
from lineweave.plans.note_queries import _SEG
from lineweave.sources.scratch import shared_dir


def _folder(spark: SparkSession, name: str) -> str:
    """A folder of its own under the shared one, whose files stay."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arriving documents; the second run finds nothing new. The table may be one file, so a pattern names it."""
    out = _folder(spark, "job1")
    for _ in range(2):
        ingest_documents.run(spark, f"{sf_dir}/documents.parque[t]", f"{out}/output", f"{out}/checkpoint")
    return ingest_documents.corpus(spark, f"{out}/output")


def job2_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and grams in one table, told apart by kind."""
    out = _folder(spark, "job2")
    for _ in range(2):
        phrase_ngrams.run(spark, f"{sf_dir}/events.parquet", f"{out}/output")
    made = phrase_ngrams.tables(spark, f"{out}/output")
    return made["phrases"].withColumn("kind", F.lit("phrases")).unionByName(made["grams"].withColumn("kind", F.lit("grams")), allowMissingColumns=True)


QUERIES = {f.__name__: f for f in (job1_ingest, job2_phrases)}

_SPLIT = "case when x < 0.8 then 'train' when x < 0.8::double + 0.1::double then 'validation' else 'test' end"
_X = "('0x' || substr(sha1('42|' || {}), 1, 8))::bigint / 4294967295.0::double"

ORACLE = {
    "job1_ingest": f"""
with d as (select * from (select doc_id, text, lang, source, row_number() over (partition by doc_id order by text nulls first, lang nulls first, source nulls first) as k from documents where doc_id is not null) where k = 1),
w as (select *, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))::int as n_words, sha256(text) as content from d),
r as (select *, case when text is null or text = '' then 'malformed' when lang is null then 'no_language' when n_words < 20 then 'too_short' when n_words > 5000 then 'too_long' end as reason from w),
k as (select *, min(case when reason is null then doc_id end) over (partition by content) as keeper from r),
f as (select doc_id, lang, source, n_words, content, coalesce(reason, case when doc_id <> keeper then 'duplicate' end) as reason, text, {_X.format('doc_id')} as x from k)
select doc_id, lang, source, n_words, content, reason, case when reason is null then text end as text, case when reason is null then {_SPLIT} else 'rejected' end as split, 0::bigint as epoch from f""",
    "job2_phrases": f"""
with {_SEG},
e2 as (select score_id, segment as phrase, count(*) as n_notes, round(min(o), 6) as start_q, round(max(o + d), 6) as end_q, arg_max(p, (o, -p, d)) - arg_min(p, (o, -p, d)) as way, max(p) - min(p) as rng
  from s group by all having count(*) >= 4),
t as (select *, 'M' || case when way > 0 then 'U' when way < 0 then 'D' else 'S' end || (rng // 6) as melody, 'R' || least(n_notes, 9) || '-' || least(floor((end_q - start_q) / 4)::bigint, 9) as rhythm from e2),
ph as materialized (select *, melody || '|' || rhythm as combined, {_X.format('score_id')} as x from t),
u as (select score_id, phrase, unnest(['melody', 'rhythm', 'combined']) as space, unnest([melody, rhythm, combined]) as t1 from ph),
l as (select *, lead(t1) over z as t2, lead(t1, 2) over z as t3 from u window z as (partition by space, score_id order by phrase)),
gr as (select space, score_id, 1 as n, t1 as gram, '' as prefix from l union all select space, score_id, 2, t1 || ' ' || t2, t1 from l where t2 is not null
  union all select space, score_id, 3, t1 || ' ' || t2 || ' ' || t3, t1 || ' ' || t2 from l where t3 is not null),
c as (select space, n, prefix, gram, score_id, count(*) as c from gr group by all),
m as (select space, n, prefix, gram, sum(c)::bigint as count, count(*) as scores, max(c) as top from c group by all)
select 'phrases' as kind, score_id, phrase, start_q, end_q, n_notes, melody, rhythm, combined, {_SPLIT} as split, null as gram, null as count, null as share, null as scores, null as concentrated, null as space, null as n from ph
union all select 'grams', null, null, null, null, null, null, null, null, null, gram, count, round(count / sum(count) over (partition by space, n, prefix), 9), scores, count >= 5 and top / count > 0.5, space, n from m""",
}
