"""Encoder data: eligible segments, batches and augmented views (survey V14-V16, V20, P8, P9, P11)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.functions.expressions import hash_order, hash_split, unit_hash
from lineweave.operators import features
from lineweave.operators.catalog import first_reason
from lineweave.operators.ranks import ranked
from lineweave.sources.scratch import written

PAD, MASK = 0, 1
#: Queries that go to all tasks in one search for hard negatives.
MOST_QUERIES = 10_000


def prepared(segments: DataFrame, least: int, most: int, min_bars: float, max_bars: float, seed: int = 42, train: float = 0.8, validation: float = 0.1) -> DataFrame:
    """All segments with reason (null: eligible), split by score, and tokens where eligible.

    segments: segment_id, score_id, license, extraction_mode, notes, n_bars. The first reason that applies counts.
    """
    n = F.size("notes")
    reason = first_reason([
        (~F.coalesce("license", F.lit(False)), "license"), (F.col("extraction_mode") != "explicit_voice", "mode"), (F.col("notes").isNull(), "malformed"),
        (~features.valid_notes(F.col("notes")), "invalid_schema"), (n < least, "too_few_notes"), (n > most, "too_many_notes"),
        (F.col("n_bars") < min_bars, "too_short"), (F.col("n_bars") > max_bars, "too_long"),
    ])
    out = segments.withColumn("reason", reason).withColumn("split", hash_split(seed, F.col("score_id"), train, validation))
    return out.withColumn("tokens", F.when(F.col("reason").isNull(), features.tokens(F.col("notes"), most)))


def score_aware_batches(rows: DataFrame, score: str, key: str, size: int, seed: int = 42) -> DataFrame:
    """Rows with the number of their batch (from 0): rows of one score only share a batch if that holds all scores.

    Rows come score by score, scores with fewer rows first (ties by score), a score's rows in seeded hash order. A
    row opens a new batch when the last one is full or has a row of its score already, unless it has all scores.
    The numbers follow from ranks of scores: scores of one row fill batches in turn; each further row of a score
    opens one.
    """
    n_rows = rows.groupBy(score).agg(F.count(F.lit(1)).alias("_n"))
    at = ranked(n_rows, [F.col("_n"), F.col(score)], "_k")
    sizes = at.groupBy("_n").agg(F.min("_k").alias("_k0"), F.count(F.lit(1)).alias("_m"))  # a row per number of rows
    ahead = Window.orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    each = F.when(F.col("_n") == 1, 0).otherwise(F.col("_n") - (0 if size == 1 else 1))  # batches that a score opens
    sizes = sizes.withColumn("_each", each).withColumn("_opened", F.coalesce(F.sum(F.col("_m") * F.col("_each")).over(ahead), F.lit(0)))
    about = at.groupBy().agg(F.count(F.lit(1)).alias("scores"), F.count_if(F.col("_n") == 1).alias("single")).first()
    scores, single = about["scores"], about["single"]
    turn = F.row_number().over(Window.partitionBy(score).orderBy(hash_order(seed, F.col(key)), key)) - 1
    placed = rows.withColumn("_turn", turn).join(at.join(sizes, "_n"), score)
    opened = F.lit(single // size) + F.col("_opened") + (F.col("_k") - F.col("_k0")) * F.col("_each")
    further = F.col("_turn")
    if scores == 1:
        opened, further = F.lit(0), F.floor(F.col("_turn") / size)
    elif 1 < scores <= size and (single == scores - 1 or scores == 2):
        # the last score's first rows meet all other scores in one batch and fill it up
        room = size - (single if single == scores - 1 else 1)
        further = F.when(F.col("_k") == scores - 1, F.greatest(F.lit(0), F.col("_turn") - (room - 1))).otherwise(F.col("_turn"))
    batch = F.when((F.col("_n") == 1) & F.lit(scores > 1), F.floor(F.col("_k") / size)).otherwise(opened + further)
    return placed.withColumn("batch", batch.cast("long")).drop("_turn", "_n", "_k", "_k0", "_m", "_each", "_opened")


def _chance(seed: int, key: Column, *about: Column | str) -> Column:
    """A number in [0, 1] that depends on seed, key and what it is for only."""
    return unit_hash(seed, F.concat_ws("|", key.cast("string"), *[F.lit(a) if isinstance(a, str) else a.cast("string") for a in about]))


def augmented(
    rows: DataFrame, key: str, tokens: str, seed: int = 42, mask_notes: float = 0.1, mask_features: float = 0.05, shift_times: float = 0.15, shift_durations: float = 0.15, thin: float = 0.05, thinned: float = 0.2
) -> DataFrame:
    """(key, tokens): a view of each row's tokens; all choices depend on seed and key alone.

    Of the inner rows each is masked as a whole, then each of its channels, then its time (channel 2) and duration
    (channel 3) move by one, not below 2, each with its probability. With probability `thin` a number of inner rows
    between none and the share `thinned` is left out, and the rest is padded at the end. The first and the last row
    that isn't padding stay. Null tokens stay null.
    """
    own = F.col(key)
    n = F.size(F.filter(tokens, lambda x: x[0] != PAD))

    def view(x: Column, i: Column) -> Column:
        note = _chance(seed, own, "note", i) < mask_notes
        masked = F.transform(x, lambda v, c: F.when(note | (_chance(seed, own, "feature", i, c) < mask_features), F.lit(MASK)).otherwise(v))
        shift = lambda c, name, p: F.when(_chance(seed, own, name, i) < p, F.greatest(F.lit(2), masked[c] + F.when(_chance(seed, own, name, i, "up") < 0.5, -1).otherwise(1))).otherwise(masked[c])
        moved = F.array(masked[0], masked[1], shift(2, "time", shift_times), shift(3, "duration", shift_durations), masked[4])
        return F.when((i > 0) & (i < n - 1), moved).otherwise(x)

    seen = F.transform(tokens, view)
    most = F.floor(F.greatest(n - 2, F.lit(0)) * thinned)
    out_of = F.when(_chance(seed, own, "thin") < thin, F.least(most, F.floor(_chance(seed, own, "gone") * (most + 1)))).otherwise(0).cast("int")
    order = F.array_sort(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.struct(_chance(seed, own, "place", i).alias("h"), i.alias("i"))))
    gone = F.when(n > 2, F.slice(F.transform(order, lambda s: s.i), 1, out_of)).otherwise(F.array().cast("array<int>"))
    rest = F.filter(F.transform(F.col("_seen"), lambda x, i: F.when(F.array_contains("_gone", i), F.lit(None)).otherwise(x)), lambda x: x.isNotNull())
    pad = F.array_repeat(F.array_repeat(F.lit(PAD), 5), F.size("_gone"))
    made = rows.select(key, tokens, seen.alias("_seen"), gone.alias("_gone"))
    return made.select(key, F.when(F.col(tokens).isNotNull(), F.concat(rest, pad)).cast("array<array<int>>").alias(tokens))


def encoded(rows: DataFrame, key: str, tokens: str, encoder: Callable[[list], np.ndarray], batch: int = 256) -> DataFrame:
    """Unit embeddings by any function from a list of token arrays to a matrix, batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), batch):
                part = pdf.iloc[lo : lo + batch]
                x = np.asarray(encoder(part[tokens].tolist()), float)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8)
                yield pd.DataFrame({key: part[key].to_numpy(), "embedding": list(x)})

    return rows.select(key, tokens).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, embedding array<double>")


def hard_negatives(rows: DataFrame, queries: DataFrame, seed: int = 42) -> DataFrame:
    """(query_id, id, token, score_id): for each query the row of another token and score nearest to it.

    Nearest in bars, then in notes, then by seeded hash. Both tables: id, token, score_id, n_bars, n_notes. Of rows
    alike in all that counts only the first by hash can be chosen, so the others don't meet the queries. Queries alike
    in the same columns have the same answer, so each kind of query is asked once, in blocks of MOST_QUERIES kinds. A
    query without any such row has none here.
    """
    alike = ["token", "score_id", "n_bars", "n_notes"]
    first = rows.groupBy(*alike).agg(F.min(F.struct(hash_order(seed, F.col("id")).alias("h"), "id")).alias("_r"))
    first = written(first, "first")
    q_alike = [f"q_{c}" for c in alike]
    asked = queries.select(*[F.col(c).alias(f"q_{c}") for c in ("id", *alike)]).where("q_token is not null and q_score_id is not null")
    kinds = written(asked.groupBy(*q_alike).agg(F.count(F.lit(1)).alias("q_n")).select(*q_alike), "kinds")
    found, blocks = None, -(-max(kinds.count(), 1) // MOST_QUERIES)
    for block in range(blocks):
        q = F.broadcast(kinds.where(F.pmod(F.xxhash64(*q_alike), F.lit(blocks)) == block))  # about MOST_QUERIES rows
        met = first.join(q, (F.col("token") != F.col("q_token")) & (F.col("score_id") != F.col("q_score_id")))
        nearness = F.struct(F.abs(F.col("n_bars") - F.col("q_n_bars")), F.abs(F.col("n_notes") - F.col("q_n_notes")), F.col("_r.h"))
        one = met.groupBy(*q_alike).agg(F.min_by(F.struct("_r.id", "token", "score_id"), nearness).alias("b"))
        found = one if found is None else found.unionByName(one)
    answers = written(found.select(*[F.col(c).alias(f"a_{c}") for c in q_alike], "b"), "answers")
    same = [F.col(c).eqNullSafe(F.col(f"a_{c}")) for c in q_alike]
    return asked.join(answers, same).select(F.col("q_id").alias("query_id"), "b.id", "b.token", "b.score_id")


def members(assigned: DataFrame, how: str, n: int, key: str, seed: int = 42) -> DataFrame:
    """N members by `random`, `centroid-nearest` or `low-confidence` order."""
    order: dict[str, list[Column]] = {
        "random": [hash_order(seed, F.col(key))], "centroid-nearest": [F.desc("cosine")], "low-confidence": [F.asc("margin"), F.asc("cosine")],
    }
    if how not in order:
        raise ValueError(f"unknown sampling {how}")
    return assigned.orderBy(*order[how], key).limit(n)
