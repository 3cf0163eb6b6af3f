"""A document pipeline of the training-data operators: language ID, near-dedup, substring dedup, packing.

Each stage but the last keeps all columns, whatever their names, and looks at doc_id, text and (to learn) lang only.
Null and empty texts and those without a letter go in the first stage. A row without an id is linked with no other and
stays. Rows that repeat an id go or stay by their own text. Texts of any length are looked at whole. An empty table
stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lineweave.llm import langid, minhash, packing, substring
from lineweave.llm.common import written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents near enough to a language learned from those with a lang; null texts and texts without letters go."""
    return langid.without_rejected(docs, langid.train(docs, "lang", "text", "doc_id"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group linked at Jaccard 0.8 on five-word shingles."""
    return minhash.without_duplicates(docs, width=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that an earlier document holds too."""
    return substring.without_repeats(docs, width=5, least_words=50, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens, placed in sequences of at most 2048."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1, length=2048)


STAGES = [("language ID", language), ("MinHash near-dedup", near_dedup), ("substring dedup", substring_dedup), ("packing", pack)]

#: Trained centroids, similarity of token sets and column generation are beyond SQL: see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each one's result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
