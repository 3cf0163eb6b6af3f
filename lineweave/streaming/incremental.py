"""Selection of rows as they arrive, each key once, whatever is replayed (survey 2.12b, K10, J5, P19).

A stream of arriving files is chosen from batch by batch. A batch leaves out the keys that earlier batches took, hands
the rest to `choose` and writes what it gives under `epoch=N`, in place of anything that a broken attempt at that
epoch left there. What the epochs before N hold is the completed table. A batch that is replayed, because the driver
ended after its files were written and before the checkpoint knew, sees the same completed table and writes the same
rows again.

The completed table is read for its keys only and meets the batch's keys first, so that it need not be shuffled where
those are few; rows that were taken lie where they are.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lineweave.operators.catalog import first_per_key
from lineweave.sources.tables import exists

log = logging.getLogger(__name__)


def taken(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """The rows that were taken, with their epoch; with `before` those of earlier epochs. Empty where there are none."""
    full = f"{schema}, epoch long"
    if not exists(spark, path):
        return spark.createDataFrame([], full)
    rows = spark.read.schema(full).parquet(path)
    return rows if before is None else rows.where(F.col("epoch") < before)


def take(batch: DataFrame, epoch: int, choose: Callable[[DataFrame, DataFrame], DataFrame], key: str, schema: str, path: str, order: list[Column], partition_by: list[str], force: bool = False) -> DataFrame:
    """Write one batch's choice under its epoch and give it back; the same for the same epoch, however often it is run.

    Rows without a key are left out, of rows that share one the first in order counts. choose gets the new rows and the
    completed table. With force keys may be taken again.
    """
    spark = batch.sparkSession
    done = taken(spark, path, schema, epoch)
    new = batch.where(F.col(key).isNotNull())
    if not force:
        known = done.select(key).join(new.select(key).distinct(), key, "left_semi").distinct()
        new = new.join(known, key, "left_anti")
    new = first_per_key(new, [key], order)
    chosen = choose(new, done).select(*StructType.fromDDL(schema).names)
    target = f"{path}/epoch={epoch}"
    chosen.write.mode("overwrite").partitionBy(*partition_by).parquet(target)
    written = taken(spark, path, schema).where(F.col("epoch") == epoch)
    log.info("epoch %d: %d rows read, %d written to %s", epoch, batch.count(), written.count(), target)
    return written


def select_arrivals(
    arrivals: DataFrame, choose: Callable[[DataFrame, DataFrame], DataFrame], key: str, schema: str, path: str, checkpoint: str, order: list[Column] | None = None, partition_by: list[str] | None = None, force: bool = False,
    after: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Choose from all files that have arrived since the last run, then stop; schema: that of what choose gives.

    after is called with what each epoch wrote, and has to bear being called again for the same epoch. Epochs are
    numbered by the checkpoint: output without its checkpoint is refused, as it would be written over.
    """
    spark = arrivals.sparkSession
    if not exists(spark, f"{checkpoint}/metadata") and exists(spark, path) and not taken(spark, path, schema).isEmpty():
        raise ValueError(f"{path} holds rows of another checkpoint than {checkpoint}")

    def batch(rows: DataFrame, epoch: int) -> None:
        done = take(rows, epoch, choose, key, schema, path, order or [F.col(c) for c in rows.columns], partition_by or [], force)
        if after is not None:
            after(done, epoch)

    return arrivals.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
