"""Intermediate tables in the folder that all executors share (spark.checkpoint.dir): written once, read back."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; without a setting a temporary one in local mode, where all tasks share this machine's disk."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="lineweave-")
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what lies there goes when the driver ends, as results are read from it till then."""
    if not _made:
        atexit.register(_clear)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def _clear() -> None:
    for spark, path in _made:
        if spark.sparkContext._jsc is None:
            return  # the session has been stopped; a cluster's own clean-up of the folder remains
        delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete the files of written() tables that nothing reads any more."""
    for path in {x.rsplit("/", 1)[0] for df in tables for x in df.inputFiles()}:
        delete(spark, path)


def collected(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps, which it does when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
