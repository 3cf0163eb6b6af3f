"""Ordered scans over keys of any size: last and next state, running sums, as-of joins (survey J14, W3, W4, W6, W8).

Rows are ranked by key and order (ranks.ranked) and dealt into blocks of SIZE ranks. A scan is a window inside each
block; what the rows of a key before the block leave behind comes in as one more row of the block. These rows follow
from one summary for each key and block, over which a second window runs: a key of a billion rows is spread over all
tasks and its second window has some 15,000 rows.

A null key is a key like any other. Rows that are alike in key and order come in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.operators.ranks import ranked
from lineweave.sources.scratch import written

#: Ranks of one block.
SIZE = 1 << 16
_PLACE = ["_rank", "_block"]


def placed(rows: DataFrame, keys: list[str], order: list[Column], size: int = SIZE) -> DataFrame:
    """rows with their place, for the scans below; unplaced() takes it away again."""
    at = ranked(rows, [*[F.col(k) for k in keys], *order], "_rank")
    return at.withColumn("_block", F.floor(F.col("_rank") / size))


def unplaced(rows: DataFrame) -> DataFrame:
    return rows.drop(*_PLACE)


def _seeded(at: DataFrame, keys: list[str], state: DataFrame, carried: Column, turn: int) -> tuple[DataFrame, Column]:
    """at with `_state` and a row for each key and block that something is carried into; whether a row is such a one."""
    w = Window.partitionBy(*keys).orderBy(F.col("_block") * turn).rowsBetween(Window.unboundedPreceding, -1)
    seeds = state.withColumn("_state", carried.over(w)).where("_state is not null").select(*keys, "_block", "_state")
    seed = F.lit(True).alias("_seed")
    first = F.lit(-1 if turn > 0 else (1 << 62)).cast("long").alias("_rank")
    return at.withColumn("_seed", F.lit(False)).unionByName(seeds.select(*keys, "_block", first, "_state", seed), allowMissingColumns=True), ~F.col("_seed")


def last_before(at: DataFrame, keys: list[str], value: Column, name: str, own: bool = False, after: bool = False) -> DataFrame:
    """at with `name`: the last value that isn't null before each row, with `own` the row's own one counting too.

    With after, the first such value behind the row. Null where there is none.
    """
    turn = -1 if after else 1
    at = at.withColumn("_state", value)
    pick = F.min_by if after else F.max_by
    state = at.groupBy(*keys, "_block").agg(pick("_state", F.when(F.col("_state").isNotNull(), F.col("_rank"))).alias("_news"))
    both, real = _seeded(at, keys, state, F.last("_news", ignorenulls=True), turn)
    w = Window.partitionBy("_block", *keys).orderBy(F.col("_rank") * turn).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    return both.withColumn(name, F.last("_state", ignorenulls=True).over(w)).where(real).drop("_state", "_seed")


def running_sum(at: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """at with `name`: the sum of the values of the key up to each row, the row's own one among them; nulls count nothing."""
    at = at.withColumn("_state", F.coalesce(value, F.lit(0)))
    state = at.groupBy(*keys, "_block").agg(F.sum("_state").alias("_news"))
    both, real = _seeded(at, keys, state, F.sum("_news"), 1)
    w = Window.partitionBy("_block", *keys).orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(name, F.sum("_state").over(w)).where(real).drop("_state", "_seed")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], time: str, columns: list[str], tolerance: Column | None = None, after: bool = False, strict: bool = False, size: int = SIZE) -> DataFrame:
    """Left with the columns and `{time}_of` of the last row of right at or before its time, of the same key.

    With after, the first at or behind it; strict leaves out equal times. Of right rows of one time the one with the
    larger columns counts, with after the smaller. Matches farther than tolerance (in units of time) are none; so are
    null times on either side. Without a match the columns are null.
    """
    found = F.struct(F.col(time).alias("t"), F.struct(*columns).alias("c"))
    rights = right.where(F.col(time).isNotNull()).select(*keys, time, found.alias("_r"))
    lefts = left.select(*keys, time, F.struct(*left.columns).alias("_l"))
    both = lefts.unionByName(rights, allowMissingColumns=True)
    left_last = after == strict  # at equal times, does left come behind right?
    side = F.when(F.col("_l").isNull(), 0).otherwise(1 if left_last else -1)
    at = placed(both, keys, [F.col(time), side, F.col("_r")], size)
    at = last_before(at, keys, F.col("_r"), "_f", after=after).where("_l is not null")
    far = F.lit(False) if tolerance is None else F.abs(F.col(time) - F.col("_f.t")) > tolerance
    match = F.when(F.col(time).isNotNull() & ~far, F.col("_f"))
    return at.select("_l.*", match.getField("t").alias(f"{time}_of"), *[match.getField("c").getField(c).alias(c) for c in columns])


def gap_segments(notes: DataFrame, keys: list[str], rest: float = 2.0, size: int = SIZE) -> DataFrame:
    """Notes.gap_segments for lines of any size: a segment ends where `rest` or more follows the note's end."""
    at = placed(notes, keys, [F.col("o"), F.desc("p"), F.col("d")], size)
    at = last_before(at, keys, F.col("o") + F.col("d"), "_pe")
    return unplaced(running_sum(at, keys, F.when(F.col("o") - F.col("_pe") >= rest, 1).otherwise(0), "segment").drop("_pe"))


def gram_counts(rows: DataFrame, keys: list[str], order: list[Column], tokens: list[str], most: int) -> DataFrame:
    """Counts of 1 to `most` tokens in a row, for each of the token columns, whatever a key's size.

    (space: the column, n, gram: array, count, share of all grams with the same n - 1 first tokens, keys_with: number
    of keys that hold it, largest_share: share of its count in the key that holds most). Null tokens count as tokens.
    Each row gives its token to the `most` windows that it lies in; windows meet by rank, not by key.
    """
    at = ranked(rows.select(F.struct(*keys).alias("_key"), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]).alias("_o"), F.struct(*tokens).alias("_t")), [F.col("_key"), F.col("_o")], "_rank")
    given = at.select("_key", "_t", "_rank", F.explode(F.array(*[F.lit(i) for i in range(most)])).alias("i")).select("_key", (F.col("_rank") - F.col("i")).alias("start"), "i", "_t")
    windows = given.groupBy("start", "_key").agg(F.array_sort(F.collect_list(F.struct("i", "_t"))).alias("w")).where("w[0].i = 0")
    grams = [F.struct(F.lit(t).alias("space"), F.lit(n).alias("n"), F.slice(F.col("w._t").getField(t), 1, n).alias("gram")) for t in tokens for n in range(1, most + 1)]
    each = windows.select("_key", F.explode(F.array(*grams)).alias("g")).select("_key", "g.*").where("size(gram) = n")
    per_key = each.groupBy("space", "n", "gram", "_key").agg(F.count(F.lit(1)).alias("c"))
    total = per_key.groupBy("space", "n", "gram").agg(F.sum("c").alias("count"), F.count(F.lit(1)).alias("keys_with"), (F.max("c") / F.sum("c")).alias("largest_share"))
    # written first, so that the join may split a prefix that most grams share, as single tokens do theirs
    total = written(total.withColumn("_prefix", F.slice("gram", F.lit(1), F.col("n") - 1)), "grams")
    prefixes = total.groupBy("space", "n", "_prefix").agg(F.sum("count").alias("_of"))
    return total.join(prefixes, ["space", "n", "_prefix"]).select("space", "n", "gram", "count", (F.col("count") / F.col("_of")).alias("share"), "keys_with", "largest_share")
