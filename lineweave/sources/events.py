"""Notes from a table of events, for lines of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.operators import scans
from lineweave.sources.scratch import written

#: Microseconds of one unit of note time.
UNIT = 21_600_000_000.0


def notes_of(events: DataFrame, size: int = scans.SIZE) -> DataFrame:
    """(score_id, part, p, o, d, us): a line per user, six hours as the unit of time, pitch from the number k in props.

    us is the time in microseconds since 1970. A note lasts to the user's next event, one unit at most. Events without a user, a time or a k are left out.
    """
    e = events.select(
        F.col("user_id").alias("score_id"), F.col("event_type").alias("part"), "event_id", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))").alias("us"),
        F.get_json_object("props", "$.k").try_cast("int").alias("k"),
    ).where("score_id is not null and us is not null and k is not null")
    e = written(e, "events")  # so that props are parsed once, not for each pass over the events
    at = scans.placed(e, ["score_id"], [F.col("us"), F.col("event_id")], size)
    at = scans.unplaced(scans.last_before(at, ["score_id"], F.col("us"), "_next", after=True))
    first = e.groupBy("score_id").agg(F.min("us").alias("_first"))
    gap = (F.col("_next") - F.col("us")) / F.lit(UNIT)
    return at.join(first, "score_id").select("score_id", "part", (F.lit(48) + F.col("k") % 37).alias("p"), ((F.col("us") - F.col("_first")) / F.lit(UNIT)).alias("o"), F.least(F.coalesce(gap, F.lit(1.0)), F.lit(1.0)).alias("d"), "us")
