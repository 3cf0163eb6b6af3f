"""Job 2: the phrases of event lines as tokens, and the counts of token sequences over all lines.

    python -m jobs.phrase_ngrams --events PATH --output DIR [--config FILE]

Reads an `events` table, takes each user's events as a line of notes, cuts lines at rests into phrases and names each
phrase by a melody, a rhythm and a combined token. Writes two tables under the output, in place of what is there:

    phrases  split=S           every phrase with its tokens, split by a hash of its line
    grams    space=T/n=N       counts of 1 to 3 tokens in a row, the share among those that begin alike, the number of
                               lines that hold them, and whether one line holds most of a frequent one

Melody tokens tell the way from first to last pitch (U, D or S) and the range in steps of six; rhythm tokens the number
of notes and of bars, nine at most. No step needs all notes of a line in one task.
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.functions.expressions import hash_split, rounded
from lineweave.operators import scans
from lineweave.sources.events import notes_of
from lineweave.sources.scratch import written
from lineweave.sources.tables import read_json

log = logging.getLogger("jobs.phrase_ngrams")

CONFIG = {"rest": 2.0, "least_notes": 4, "most_tokens": 3, "least_count": 5, "concentrated_above": 0.5, "seed": 42, "train": 0.8, "validation": 0.1}
PHRASES = "score_id long, phrase long, start_q double, end_q double, n_notes long, melody string, rhythm string, combined string, split string"
GRAMS = "gram string, count long, share double, scores long, concentrated boolean, space string, n int"


def phrases(notes: DataFrame, config: dict, size: int = scans.SIZE) -> DataFrame:
    """(score_id, phrase, start_q, end_q, n_notes, melody, rhythm, combined, split) of all phrases that are long enough."""
    cut = scans.gap_segments(notes, ["score_id"], config["rest"], size)
    order = F.struct("o", -F.col("p"), "d")
    each = cut.groupBy("score_id", F.col("segment").alias("phrase")).agg(
        F.count(F.lit(1)).alias("n_notes"), rounded(F.min("o")).alias("start_q"), rounded(F.max(F.col("o") + F.col("d"))).alias("end_q"),
        (F.max_by("p", order) - F.min_by("p", order)).alias("_way"), (F.max("p") - F.min("p")).alias("_range"),
    ).where(F.col("n_notes") >= config["least_notes"])
    melody = F.concat(F.lit("M"), F.when(F.col("_way") > 0, "U").when(F.col("_way") < 0, "D").otherwise("S"), F.floor(F.col("_range") / 6).cast("string"))
    bars = F.least(F.floor((F.col("end_q") - F.col("start_q")) / 4), F.lit(9))
    rhythm = F.concat(F.lit("R"), F.least("n_notes", F.lit(9)).cast("string"), F.lit("-"), bars.cast("string"))
    named = each.withColumn("melody", melody).withColumn("rhythm", rhythm).withColumn("combined", F.concat_ws("|", "melody", "rhythm"))
    return named.withColumn("split", hash_split(config["seed"], F.col("score_id"), config["train"], config["validation"])).drop("_way", "_range")


def grams(tokens: DataFrame, config: dict) -> DataFrame:
    """(gram, count, share, scores, concentrated, space, n) of all phrases' tokens."""
    counts = scans.gram_counts(tokens, ["score_id"], [F.col("phrase")], ["melody", "rhythm", "combined"], config["most_tokens"])
    much = (F.col("count") >= config["least_count"]) & (F.col("largest_share") > config["concentrated_above"])
    return counts.select(F.array_join("gram", " ").alias("gram"), "count", F.round("share", 9).alias("share"), F.col("keys_with").alias("scores"), much.alias("concentrated"), "space", "n")


def run(spark: SparkSession, events: str, output: str, config: dict | None = None) -> dict[str, int]:
    """Write both tables anew; gives the numbers of their rows."""
    config = CONFIG | (config or {})
    if unknown := set(config) - set(CONFIG):
        raise ValueError(f"unknown settings {sorted(unknown)}")
    rows = spark.read.parquet(events)
    log.info("read %d events from %s", rows.count(), events)
    # written first: what ranks the notes reads them twice, to sample their order and to deal them out
    phrases(written(notes_of(rows), "notes"), config).write.mode("overwrite").partitionBy("split").parquet(f"{output}/phrases")
    grams(spark.read.schema(PHRASES).parquet(f"{output}/phrases"), config).write.mode("overwrite").partitionBy("space", "n").parquet(f"{output}/grams")
    made = {name: table.count() for name, table in tables(spark, output).items()}
    log.info("wrote %d phrases and %d grams to %s", made["phrases"], made["grams"], output)
    return made


def tables(spark: SparkSession, output: str) -> dict[str, DataFrame]:
    return {"phrases": spark.read.schema(PHRASES).parquet(f"{output}/phrases"), "grams": spark.read.schema(GRAMS).parquet(f"{output}/grams")}


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("--events", "--output"):
        p.add_argument(name, required=True)
    p.add_argument("--config", help="a JSON file; jobs/phrase_ngrams.json shows all settings")
    got = p.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("phrase_ngrams").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, got.events, got.output, read_json(spark, got.config) if got.config else None)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
