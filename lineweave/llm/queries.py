"""The opN_ queries of this subpackage with their production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lineweave.llm import bpe, brown, embed_dedup, langid, merkle, minhash, packing, substring, tiff, tokencount, urlfilter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1, length=2048)


def op8_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"), least=0.9)


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeats(_table(spark, sf_dir, "documents"), width=5, least_words=50, percent=80)


def op2_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.media_digests(_table(spark, sf_dir, "documents"))


def op3_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = urlfilter.train(urlfilter.labelled_table(spark, urlfilter.LABELLED))
    return urlfilter.judge(_table(spark, sf_dir, "pages"), weights, urlfilter.RULES)


def op4_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score_held_out(_table(spark, sf_dir, "documents"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op10_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(_table(spark, sf_dir, "pages"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tamper_check(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring": op1_substring,
    "op2_tiff": op2_tiff,
    "op3_urlfilter": op3_urlfilter,
    "op4_brown": op4_brown,
    "op5_langid": op5_langid,
    "op6_bpe": op6_bpe,
    "op7_packing": op7_packing,
    "op8_embed_dedup": op8_embed_dedup,
    "op9_minhash": op9_minhash,
    "op10_tokencount": op10_tokencount,
    "op11_warc": op11_warc,
    "op12_merkle": op12_merkle,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

ORACLE: dict[str, str] = {
    "op3_urlfilter": urlfilter.oracle(),
    "op11_warc": warc.oracle(),
    "op12_merkle": merkle.oracle(),
    "op8_embed_dedup": """
with recursive v as materialized (
  select vec_id, embedding::double[] as e, list_dot_product(embedding::double[], embedding::double[]) as s from embeddings),
u as materialized (
  select vec_id, e, sqrt(s) as norm from v
  where s > 0 and isfinite(s) and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0),
link as materialized (
  select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),
reach(vec_id, r) as (select vec_id, vec_id from v union select reach.vec_id, link.b from reach join link on link.a = reach.r),
n as (select a, count(*) as n from link group by a)
select v.vec_id, coalesce(any_value(n.n), 0)::bigint as n_links, min(r) as component_id, v.vec_id = min(r) as kept
from v join reach using (vec_id) left join n on n.a = v.vec_id group by v.vec_id""",
    "op9_minhash": f"""
with recursive w as (select doc_id, {_WORDS} as ws from documents),
s as materialized (
  select doc_id, list_distinct(case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) end) as sh from w),
x as materialized (select doc_id, unnest(sh) as k from s),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as common from x a join x b on a.k = b.k and a.doc_id <> b.doc_id group by all),
link as materialized (
  select a, b from shared join s sa on sa.doc_id = a join s sb on sb.doc_id = b
  where 100 * common >= 85 * (len(sa.sh) + len(sb.sh) - common)),
reach(doc_id, r) as (select doc_id, doc_id from s union select reach.doc_id, link.b from reach join link on link.a = reach.r)
select s.doc_id, len(s.sh)::bigint as n_shingles, min(r) as component_id, s.doc_id = min(r) as kept
from s join reach using (doc_id) group by s.doc_id, s.sh""",
}
