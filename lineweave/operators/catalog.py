"""Catalog selection and lookup (survey S1, P1-P7, P9, P10, P16-P20, O1-O4, O11, J5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.functions.expressions import all_of, boolize, hash_order
from lineweave.operators.ranks import ranked

# Named subsets and the flags that each one requires.
SUBSETS = {
    "no_license_conflict": ["subset:no_license_conflict"],
    "safe_deduplicated": ["subset:no_license_conflict", "subset:deduplicated"],
    "safe_rated_deduplicated": ["subset:no_license_conflict", "subset:rated_deduplicated"],
}


def normalized(catalog: DataFrame, flag_prefix: str = "subset:") -> DataFrame:
    """Every column named with the prefix becomes boolean."""
    return catalog.withColumns({c: boolize(F.col(f"`{c}`")) for c in catalog.columns if c.startswith(flag_prefix)})


def subset(catalog: DataFrame, name: str, path_col: str, subsets: dict[str, list[str]] | None = None) -> DataFrame:
    """Rows with all flags of the named subset and a non-empty path."""
    known = subsets or SUBSETS
    if name not in known:
        raise ValueError(f"unknown subset {name}; known: {sorted(known)}")
    missing = [c for c in known[name] if c not in catalog.columns]
    if missing:
        raise KeyError(f"the catalog has no column {missing}")
    return catalog.where(all_of([F.col(f"`{c}`") for c in known[name]]) & F.col(path_col).isNotNull() & (F.col(path_col) != ""))


def sampled(catalog: DataFrame, how: str, n: int, key: str, score: Column | None = None, seed: int = 42) -> DataFrame:
    """N rows: `random` by seeded hash, `quality` by falling score then key, `first` by key."""
    order = {"random": [hash_order(seed, F.col(key))], "quality": [score.desc() if score is not None else None], "first": []}
    if how not in order:
        raise ValueError(f"unknown sampling {how}")
    return catalog.orderBy(*order[how], F.col(key)).limit(n)


def first_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def one(rows: DataFrame, key: str, value) -> DataFrame:
    """The row with that key, at most one."""
    return rows.where(F.col(key) == F.lit(value)).limit(1)


def get(rows: DataFrame, key: str, value):
    """The row with that key; KeyError if there is none."""
    found = one(rows, key, value).first()
    if found is None:
        raise KeyError(value)
    return found


def drill_down(rows: DataFrame, key: str, value, order: list[str]) -> DataFrame:
    """P5: all rows of a key in order."""
    return rows.where(F.col(key) == F.lit(value)).orderBy(*[F.col(c).asc_nulls_last() for c in order])


def search(rows: DataFrame, patterns: dict[str, str | None]) -> DataFrame:
    """Rows whose columns match all given case-insensitive patterns; null counts as empty text."""
    return rows.where(all_of([F.coalesce(F.col(c), F.lit("")).rlike(f"(?i){p}") for c, p in patterns.items() if p]))


def counts_per_filter(rows: DataFrame, filters: dict[str, Column]) -> DataFrame:
    """P10: one row per predicate with the rows that satisfy it, each counted on its own, in one pass."""
    one_row = rows.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(p).alias(n) for n, p in filters.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("n")) for n in ("total", *filters)])
    return one_row.select(F.inline(pairs))


def first_reason(cases: list[tuple[Column, str]]) -> Column:
    """The first reason whose condition holds, null for none."""
    out = F.when(cases[0][0], cases[0][1])
    for condition, reason in cases[1:]:
        out = out.when(condition, reason)
    return out


def unseen(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among the seen ones."""
    return rows.join(seen.select(key).distinct(), key, "left_anti")


def masked(rows: DataFrame, hidden: list[str]) -> DataFrame:
    """P20: without the columns that would give an answer away."""
    return rows.drop(*hidden)


def evenly_spaced(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The rows at positions floor(i * (count - 1) / (n - 1)) of the ordered rows."""
    if n <= 0:
        return rows.limit(0)
    placed = ranked(rows, order, "_rank")
    last = placed.count() - 1
    return placed.where(F.col("_rank").isin(sorted({int(i * last / max(1, n - 1)) for i in range(n)}))).drop("_rank")


def fixed_queries(rows: DataFrame, n: int = 100) -> DataFrame:
    """N evenly spaced rows of the test split (where there is a split) and explicit voices, by score, length and id."""
    own = rows.where(F.col("split") == "test") if "split" in rows.columns else rows
    return evenly_spaced(own.where(F.col("extraction_mode") == "explicit_voice"), [F.col("score_id"), F.col("n_bars"), F.col("segment_id")], n)


def displayed(rows: DataFrame, similarity: str = "similarity") -> DataFrame:
    """What a result list shows: id, score, instrument, title, measures as `first - last`, rounded similarity.

    A missing title is empty text; of missing measures the known one alone is shown.
    """
    measures = F.concat_ws(" - ", F.col("start_measure").cast("string"), F.col("end_measure").cast("string"))
    return rows.select("segment_id", "score_id", "instrument_name", F.coalesce("title", F.lit("")).alias("title"), measures.alias("measures"), F.round(similarity, 4).alias("similarity"))


def aligned(ids: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The rows in terms of a list of ids: one per id, with nulls where there is none. A repeated key is an error."""
    twice = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not twice.isEmpty():
        raise ValueError(f"{key} {twice.first()[0]!r} isn't unique")
    return ids.select(key).join(rows, key, "left")


def looked_up(rows: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Rows with the index's columns; KeyError if a row's key isn't in the index."""
    missing = rows.join(index.select(key), key, "left_anti")
    if not missing.isEmpty():
        raise KeyError(missing.select(key).first()[0])
    return rows.join(index, key)
