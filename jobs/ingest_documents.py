"""Job 1: documents that have arrived since the last run are checked, deduplicated, split and added to a corpus.

    python -m jobs.ingest_documents --documents DIR --output DIR --checkpoint DIR [--config FILE]

Reads Parquet files of `documents` as they are added under a path (a folder, or a pattern of files) and writes two tables under the output:

    corpus   epoch=N/split=S   every document once: its text where it is kept, and the reason where it is not
    counts   epoch=N           documents and words by language, split and reason that this epoch added

A document is checked for the first reason that applies: malformed (no text), no_language, too_short, too_long (in
words), duplicate (its text is that of a document kept earlier, or in the same run of one with a smaller id). Kept
documents are train, validation or test by a hash of their id; the others' split is `rejected` and their text is not
kept. A document without an id is left out; of documents that share one in a run, the smallest by text counts, and
later ones are known already. A run without new files adds nothing. A run that was broken off is completed by the next.
"""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.functions.expressions import hash_split
from lineweave.operators.catalog import first_reason
from lineweave.sources.tables import read_json
from lineweave.streaming.incremental import select_arrivals, taken

log = logging.getLogger("jobs.ingest_documents")

CONFIG = {"least_words": 20, "most_words": 5000, "seed": 42, "train": 0.8, "validation": 0.1, "max_files_per_trigger": None}
ARRIVING = "doc_id long, text string, lang string, source string"
CORPUS = "doc_id long, lang string, source string, n_words int, content string, reason string, text string, split string"
COUNTS = "lang string, split string, reason string, documents long, words long, epoch long"


def checked(docs: DataFrame, corpus: DataFrame, config: dict) -> DataFrame:
    """New documents with content (a digest of the text), n_words, reason and split, given the corpus so far."""
    docs = docs.withColumn("n_words", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).withColumn("content", F.sha2("text", 256))
    first = first_reason([
        (F.col("text").isNull() | (F.octet_length("text") == 0), "malformed"), (F.col("lang").isNull(), "no_language"),
        (F.col("n_words") < config["least_words"], "too_short"), (F.col("n_words") > config["most_words"], "too_long"),
    ])
    docs = docs.withColumn("reason", first)
    fair = docs.where("reason is null").select("content", "doc_id")
    # one keeper a content, found by partial minima; both joins are by more or fewer keys than a content has copies
    keeper = fair.groupBy("content").agg(F.min("doc_id").alias("doc_id"))
    kept = corpus.where("reason is null").select("content").join(keeper.select("content"), "content", "left_semi").distinct()
    keeper = keeper.join(kept, "content", "left_anti").select("content", "doc_id", F.lit(True).alias("_keep"))
    docs = docs.join(keeper, ["content", "doc_id"], "left")
    docs = docs.withColumn("reason", F.coalesce("reason", F.when(F.col("_keep").isNull(), "duplicate")))
    split = hash_split(config["seed"], F.col("doc_id"), config["train"], config["validation"])
    return docs.withColumn("split", F.when(F.col("reason").isNull(), split).otherwise("rejected")).withColumn("text", F.when(F.col("reason").isNull(), F.col("text")))


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, config: dict | None = None) -> dict[str, int]:
    """Take all documents that are new; gives the numbers of batches and of documents that this run added."""
    config = CONFIG | (config or {})
    if unknown := set(config) - set(CONFIG):
        raise ValueError(f"unknown settings {sorted(unknown)}")
    reader = spark.readStream.schema(ARRIVING)
    if config["max_files_per_trigger"]:
        reader = reader.option("maxFilesPerTrigger", config["max_files_per_trigger"])
    added = []

    def counted(rows: DataFrame, epoch: int) -> None:
        counts = rows.groupBy("lang", "split", "reason").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("n_words").cast("long")).alias("words"))
        counts.write.mode("overwrite").parquet(f"{output}/counts/epoch={epoch}")
        added.append(epoch)

    query = select_arrivals(
        reader.parquet(documents), lambda new, corpus: checked(new, corpus, config), "doc_id", CORPUS, f"{output}/corpus", checkpoint, [F.col("text"), F.col("lang"), F.col("source")], ["split"], after=counted,
    )
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    sums = totals(spark, output).where(F.col("epoch").isin(added)).agg(F.sum("documents")).first() if added else [0]
    log.info("%d batches of %s; %d documents added to %s", len(added), documents, sums[0] or 0, output)
    return {"batches": len(added), "added": sums[0] or 0}


def totals(spark: SparkSession, output: str) -> DataFrame:
    """What each epoch added; totals over all epochs are sums of it and need no look at the corpus."""
    return spark.read.schema(COUNTS).parquet(f"{output}/counts")


def corpus(spark: SparkSession, output: str) -> DataFrame:
    """The corpus as it stands, rejected documents among it."""
    return taken(spark, f"{output}/corpus", CORPUS)


def main(args: list[str]) -> None:
    p = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("--documents", "--output", "--checkpoint"):
        p.add_argument(name, required=True)
    p.add_argument("--config", help="a JSON file; jobs/ingest_documents.json shows all settings")
    got = p.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("ingest_documents").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, got.documents, got.output, got.checkpoint, read_json(spark, got.config) if got.config else None)
    finally:
        spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
