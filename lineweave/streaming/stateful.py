"""Streams with state by key: phrases of live lines, and vote counts that only changes are added to (survey 2.12).

State lies in RocksDB under the checkpoint, dealt by key over the shuffle partitions, so that a batch costs what it
brings. Both run on Spark's own batches, watermarks and timers; a batch that is replayed starts from the state before.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lineweave.operators.reviews import COUNTS, partial_counts, summarised

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
# Fixed value: the class of Spark's state store on disk.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """A stream that starts inside takes the setting with it; the session's own one comes back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


#: A note that waits, as bytes: onset, pitch, duration, milliseconds of event time.
_NOTE = struct.Struct("<didq")
_FOUND = Row("line", "phrase", "start_q", "end_q", "n_notes")


class _Phrases(StatefulProcessor):
    """Holds back a line's notes until the watermark has passed them, and the phrase that they continue until it is over.

    Each call to the state is a message to another process, which costs more than a line's few notes do. So all that is
    known of a line is one value, read and written once a batch, and a line has one timer at most, which stays where it
    is while it comes early enough.
    """

    def __init__(self, rest: float, beat_ms: float) -> None:
        self.rest, self.beat_ms = rest, beat_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # of the last phrase its number, start, end of the last note, largest end, notes (0: it is over), and when no note
        # can continue it any more; then the timer (0: none) and the notes that wait
        self.line = handle.getValueState("line", "number long, start double, last double, end double, n long, over long, timer long, waiting binary")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        new = [(math.nan if r["o"] is None else r["o"], r["p"], math.nan if r["d"] is None else r["d"], r["ms"]) for r in rows if r["p"] is not None]
        yield from self._advance(key, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        yield from self._advance(key, [], timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())

    def _advance(self, key: Any, new: list[tuple], now: int, fired: int = 0) -> Iterator[Row]:
        known = self.line.get()
        if known is None and not new:
            return
        number, start, last, end, n, over, timer, waiting = known or (-1, 0.0, 0.0, 0.0, 0, 0, 0, b"")
        notes = sorted([*_NOTE.iter_unpack(waiting), *new], key=lambda x: (x[0], -x[1], x[2]))
        rest = [x for x in notes if x[3] > now]
        for o, _, d, ms in notes:
            if ms > now:
                continue
            if n == 0 or o - last >= self.rest:
                if n:
                    yield _FOUND(key[0], number, start, end, n)
                number, start, end, n = number + 1, o, o + d, 0
            last, end, n = o + d, max(end, o + d), n + 1
            over = math.ceil(ms + 1 + (d + self.rest) * self.beat_ms)
        if n and over <= now:
            yield _FOUND(key[0], number, start, end, n)
            n = 0  # only its number counts from here on
        marks = [x[3] for x in rest] + ([over] if n else [])
        wanted = max(min(marks), now + 1) if marks else 0
        if not now < timer <= wanted:
            if timer and timer != fired:  # Spark takes away the one that has fired
                self.handle.deleteTimer(timer)
            if wanted:
                self.handle.registerTimer(wanted)
            timer = wanted
        self.line.update((number, start, last, end, n, over, timer, b"".join(_NOTE.pack(*x) for x in rest)))

    def close(self) -> None:
        pass


def live_phrases(notes: DataFrame, line: str, rest: float = 2.0, beat_ms: float = 1000.0, late: str = "0 seconds") -> DataFrame:
    """(line, phrase, start_q, end_q, n_notes) of each phrase of a stream of notes, once it is over.

    notes: the line's column, t (event time), o and d in beats, p; the same phrases as notes.gap_segments makes of all
    notes at once, in whatever batches they come. A phrase is over when the watermark is `rest` beats past the end of
    its last note; beat_ms is the length of a beat in event time. Notes later than the watermark are left out, so
    `late` is how late a note may come. Rows without a pitch are heartbeats that only move the watermark on. Notes of a
    line wait in one task's state for as long as `late` says.
    """
    kind = notes.schema[line].dataType.simpleString()
    heard = notes.select(F.col(line).alias("line"), F.col("t").cast("timestamp").alias("t"), F.col("o").cast("double").alias("o"), F.col("p").cast("int").alias("p"), F.col("d").cast("double").alias("d"))
    at = F.coalesce(F.unix_millis("t"), F.lit(-(1 << 53)))  # a note without a time waits for nothing
    heard = heard.withColumn("ms", at).withWatermark("t", late)
    shape = f"line {kind}, phrase long, start_q double, end_q double, n_notes long"
    return heard.groupBy("line").transformWithState(_Phrases(rest, beat_ms), shape, "append", "EventTime").withColumnRenamed("line", line)


def write_live_phrases(notes: DataFrame, line: str, path: str, checkpoint: str, **how: Any) -> StreamingQuery:
    """Append the phrases that are over to a Parquet table, from all notes that have come since the last run."""
    with _state_on_disk(notes.sparkSession):
        return live_phrases(notes, line, **how).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _Earliest(StatefulProcessor):
    """Keeps each key's earliest vote; gives a vote that counts now as +1 and the one that no longer does as -1."""

    def __init__(self, schema: str, columns: list[str]) -> None:
        self.schema, self.columns = schema, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.vote = handle.getValueState("vote", self.schema)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = [tuple(None if pd.isna(x) else x.item() if hasattr(x, "item") else x for x in r) for pdf in rows for r in pdf[self.columns].itertuples(index=False, name=None)]
        old = tuple(self.vote.get()) if self.vote.exists() else None
        rank = lambda v: tuple((x is not None, x) for x in v[:2])  # noqa: E731  nulls first, as in a batch
        first = min([*new, *([old] if old else [])], key=rank)
        if first != old:
            self.vote.update(first)
            out = pd.DataFrame([(*first, 1), *([(*old, -1)] if old else [])], columns=[*self.columns, "delta"])
            yield out.astype({c: "boolean" for c in ("won", "tie", "both_poor")})

    def close(self) -> None:
        pass


def write_vote_counts(votes: DataFrame, keys: list[str], by: list[str], time: str, ordinal: str, path: str, checkpoint: str) -> StreamingQuery:
    """What each batch of votes changes in the counts over the earliest votes by key, under `epoch=N`.

    votes: keys, by, time, ordinal (to part equal times), won, tie, both_poor. A vote that comes later but is earlier
    replaces the one that was counted, which is then taken off. vote_counts() and live_vote_summary() read the result.
    """
    columns = [time, ordinal, *by, "won", "tie", "both_poor"]
    state = ", ".join(f"`{c}` {votes.schema[c].dataType.simpleString()}" for c in columns)
    rows = votes.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], *columns)

    def batch(changes: DataFrame, epoch: int) -> None:
        partial_counts(changes, by, F.col("delta")).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    with _state_on_disk(votes.sparkSession):
        changed = rows.groupBy(*[f"_key{i}" for i in range(len(keys))]).transformWithStateInPandas(_Earliest(state, columns), f"{state}, delta int", "update", "None")
        return changed.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_vote_summary(spark: SparkSession, path: str, by: dict[str, str], least: int = 50) -> DataFrame:
    """The summary of all votes so far, as reviews.vote_summary gives it, from the changes alone; by: names and types."""
    names = ", ".join([*[f"`{c}` {t}" for c, t in by.items()], *[f"{c} long" for c in COUNTS]])
    changes = spark.read.schema(f"{names}, epoch long").parquet(path)
    total = changes.groupBy(*by).agg(*[F.sum(c).alias(c) for c in COUNTS]).where("votes > 0")
    return summarised(total, least)
