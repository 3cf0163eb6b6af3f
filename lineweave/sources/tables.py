"""Sources and sinks of tables, logs and manifests (survey S1-S3, S7, S9-S11, K1-K5, K8, K10, 2.15)."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave import schemas
from lineweave.functions.expressions import boolize


def catalog(spark: SparkSession, path: str, root: str = "", schema: str = schemas.CATALOG) -> DataFrame:
    """A catalog CSV with an explicit schema; flags become boolean, mxl_path is the path under root."""
    raw = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False).csv(path)
    flags = {c: boolize(F.col(f"`{c}`")) for c in raw.columns if c.startswith("subset:")}
    return raw.withColumns(flags).withColumn("mxl_path", F.when(F.col("mxl").isNotNull() & (F.col("mxl") != ""), F.concat(F.lit(root.rstrip("/") + "/"), F.regexp_replace("mxl", r"^\./", ""))))


def parquet(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A Parquet table; with a schema none is inferred. Vectors are array<float> columns."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """K1, K2, K5: Parquet with zstd; the commit protocol makes a write whole or absent."""
    w = df.write.mode(mode).option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K3, K4: CSV with a header; mode append for logs, each append being its own file."""
    df.write.mode(mode).option("header", True).csv(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV log; an empty table where there is none yet."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).csv(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """K8: one JSON document on any store: written beside its place and renamed."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    fs = target.getFileSystem(conf)
    out = fs.create(beside, True)
    out.write(bytearray(json.dumps(value, indent=2, sort_keys=True, default=str).encode()))
    out.close()
    fs.delete(target, False)
    fs.rename(beside, target)


def read_json(spark: SparkSession, path: str) -> dict:
    """S7."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def manifests(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(path, body) of all manifests of that name under root, in order of path: discovery of codebooks and runs."""
    if not exists(spark, root):
        return spark.createDataFrame([], "path string, body string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root)
    return files.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("path"), F.col("content").cast("string").alias("body")).orderBy("path")


def indexed_runs(spark: SparkSession, root: str, index: str = "manifest.json") -> list[str]:
    """The names of the runs under root that hold a saved index, in order; a run is a folder of root."""
    found = manifests(spark, root, index).select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("run")).distinct().orderBy("run")
    return [r["run"] for r in found.collect()]  # a row per run


def checksum(value: dict) -> str:
    """of a JSON value with sorted keys."""
    return hashlib.sha1(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha1) of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha1("content").alias("sha1"))


def mark_completed(done: DataFrame, path: str) -> None:
    """Remember scores as completed."""
    done.select("score_id", "mxl_path").write.mode("append").option("header", True).csv(path)


def not_completed(spark: SparkSession, scores: DataFrame, path: str, force: bool = False) -> DataFrame:
    """Scores that no earlier run completed; all with force."""
    if force or not exists(spark, path):
        return scores
    done = spark.read.schema("score_id string, mxl_path string").option("header", True).csv(path).select("score_id").distinct()
    return scores.join(done, "score_id", "left_anti")


def verified_files(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """(name, found, ok) of files that were fetched, against expected (name, md5); fetching itself is outside.

    A file that is missing has found = false; one of another content ok = false.
    """
    here = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.md5("content").alias("_md5"))
    return expected.join(here, "name", "left").select("name", F.col("_md5").isNotNull().alias("found"), F.coalesce(F.col("_md5") == F.lower("md5"), F.lit(False)).alias("ok"))


def json_records(df: DataFrame) -> DataFrame:
    """F16: one JSON text per row, for clients; NaN and infinite numbers become null."""
    safe = [F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None)).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*safe), {"ignoreNullFields": "false"}).alias("record"))
