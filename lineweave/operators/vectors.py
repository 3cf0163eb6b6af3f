"""Vector search and assignment (survey V3, V6, V11, V12, V18, V22-V24, J7-J9, J12, J13, P12-P14, W1, W9, W10).

Searches of a stated query set compare it with all rows in blocks: queries travel to the tasks, at most MOST_QUERIES
in one search of the rows, each task keeps the k best per query, and a window merges the tasks' lists. Searches
within groups are equi-joins on the group with the cheap predicates first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.functions.expressions import dot, unit
from lineweave.operators import ranks
from lineweave.sources.scratch import written

#: Queries that one search sends to all tasks; more are dealt by a hash of their id and searched block by block.
MOST_QUERIES = 20_000
#: Rows of one block of a group in which pairs are looked for.
GRID = 2048
#: Rows of one batch whose views are all compared with each other.
MOST_IN_BATCH = 4096


def length_ratio(candidate: Column, query: Column, low: float, high: float) -> Column:
    """Candidate length over query length within [low, high]."""
    return (candidate / F.greatest(F.lit(1e-6), query)).between(low, high)


def apart(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Two intervals share no time."""
    return (end_b <= start_a) | (start_b >= end_a)


def nearest(corpus: DataFrame, queries: DataFrame, k: int, same_instrument: bool = False, other_score: bool = True, same_split: bool = False, ratio: tuple[float, float] | None = None) -> DataFrame:
    """(query_id, rank, id, similarity): the k rows most similar by cosine, exactly; never the query itself.

    Both tables: id, vector, and score_id, split, instrument, bars as far as predicates need them. Similarities are
    compared rounded to 9 places, ties go to the smaller id. Rows with null or zero vectors are no neighbours.
    """
    need = ["id"] + ["score_id"] * other_score + ["split"] * same_split + ["instrument"] * same_instrument + ["bars"] * (ratio is not None)
    wanted = queries.select(*need, "vector").where("vector is not null")
    n, kind = wanted.count(), corpus.schema["id"].dataType.simpleString()
    name = f"query_id {kind}, id {kind}, similarity double"
    if not n:
        return corpus.sparkSession.createDataFrame([], f"query_id {kind}, rank int, id {kind}, similarity double")
    found, blocks, rows = None, -(-n // MOST_QUERIES), corpus.select(*need, "vector").where("vector is not null")
    if blocks > 1:
        # each block reads all rows, which are dealt evenly once so that the blocks' tasks are alike
        rows = written(rows.repartition(max(1, -(-3 * corpus.sparkSession.sparkContext.defaultParallelism // blocks))), "corpus")
    for block in range(blocks):
        q = (wanted.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block) if blocks > 1 else wanted).toPandas()
        for lo in range(0, len(q), MOST_QUERIES):  # a block may be a little larger than the others
            part = _block(rows, q.iloc[lo : lo + MOST_QUERIES], need, k, name, same_instrument, other_score, same_split, ratio)
            found = part if found is None else found.unionByName(part)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "similarity")


def _block(corpus: DataFrame, q: pd.DataFrame, need: list[str], k: int, name: str, same_instrument: bool, other_score: bool, same_split: bool, ratio: tuple[float, float] | None) -> DataFrame:
    """(query_id, id, similarity): of each task's rows the k most similar to each query of q.

    A task keeps its k best so far and looks closer only at rows that reach the last of them, of which there are ever
    fewer: 64 rows are met first, then twice as many each time.
    """
    about = {c: q[c].to_numpy() for c in need}
    shared = corpus.sparkSession.sparkContext.broadcast((_unit_rows(q["vector"]), about))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, of = shared.value
        spans = [slice(a, min(a + 1024, len(own))) for a in range(0, len(own), 1024)]
        best: list = [None] * len(spans)  # per span: query (its place in the span), similarity, id
        least = np.full(len(own), -np.inf)
        size = 64
        for pdf in batches:
            lo = 0
            while lo < len(pdf):
                part, lo, size = pdf.iloc[lo : lo + size], lo + size, min(2 * size, 2048)
                x = _unit_rows(part["vector"])
                fine = np.flatnonzero(np.abs(x).sum(1) > 0)
                x, part = x[fine], part.iloc[fine]
                there = {c: part[c].to_numpy() for c in need}
                for i, rows in enumerate(spans):
                    s = own[rows] @ x.T
                    at, row = np.nonzero(s >= (least[rows, None] - 1e-9))
                    if not len(at):
                        continue
                    asked, value = at + rows.start, np.round(s[at, row], 9)
                    ok = np.isfinite(value) & (of["id"][asked] != there["id"][row])
                    if other_score:
                        ok &= of["score_id"][asked] != there["score_id"][row]
                    if same_split:
                        ok &= of["split"][asked] == there["split"][row]
                    if same_instrument:
                        ok &= of["instrument"][asked] == there["instrument"][row]
                    if ratio:
                        r = there["bars"][row].astype(float) / np.maximum(1e-6, of["bars"][asked].astype(float))
                        ok &= (r >= ratio[0]) & (r <= ratio[1])
                    at, value, ids = at[ok], value[ok], there["id"][row[ok]]
                    if not len(at):
                        continue
                    if best[i] is not None:
                        at, value, ids = (np.concatenate(z) for z in zip(best[i], (at, value, ids), strict=True))
                    order = np.lexsort((ids, -value, at))
                    at = at[order]
                    turn = np.arange(len(at)) - np.searchsorted(at, at)
                    order, at = order[turn < k], at[turn < k]
                    best[i] = at, value[order], ids[order]
                    last = turn[turn < k] == k - 1
                    least[at[last] + rows.start] = best[i][1][last]
        for rows, held in zip(spans, best, strict=True):
            if held is not None:
                yield pd.DataFrame({"query_id": of["id"][held[0] + rows.start], "id": held[2], "similarity": held[1]})

    return corpus.mapInPandas(search, name)


def _unit_rows(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(float)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8)


def mean_centroids(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """(cluster_id, centroid): the normalised mean of each group's vectors."""
    each = rows.select(group, F.posexplode(vector).alias("at", "x")).groupBy(group, "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    packed = each.groupBy(F.col(group).alias("cluster_id")).agg(F.array_sort(F.collect_list(F.struct("at", "x"))).getField("x").alias("c"))
    return packed.select("cluster_id", unit(F.col("c")).alias("centroid"))


def assign(rows: DataFrame, centroids: list[tuple[int, list[float]]], key: str, vector: str) -> DataFrame:
    """(key, cluster_id, cosine, second_cosine, margin) by the most similar centroid; ties: smaller number.

    The codebook, whose size doesn't depend on the rows, goes to the tasks; rows meet it in block products. Cosines
    count rounded to 9 places; k = 1 has second -1; a null vector has no assignment and no row.
    """
    book = sorted((int(i), c) for i, c in centroids)
    numbers, matrix = np.array([i for i, _ in book]), _unit_rows(pd.Series([c for _, c in book]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[pdf[vector].notna()]
            for lo in range(0, len(pdf), 4096):
                part = pdf.iloc[lo : lo + 4096]
                s = np.round(_unit_rows(part[vector]) @ matrix.T, 9)
                at = np.arange(len(s))
                best = np.argmax(s, axis=1)
                first = s[at, best]
                s[at, best] = -np.inf
                second = s.max(1) if len(numbers) > 1 else np.full(len(s), -1.0)
                yield pd.DataFrame({key: part[key].to_numpy(), "cluster_id": numbers[best].astype(np.int32), "cosine": first, "second_cosine": second, "margin": first - second})

    return rows.select(key, vector).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, cluster_id int, cosine double, second_cosine double, margin double")


def ranked(assigned: DataFrame, key: str) -> DataFrame:
    """The rank of each row in its cluster by falling cosine, ties by key; no task needs a whole cluster."""
    placed = ranks.ranked(assigned, [F.col("cluster_id"), F.desc("cosine"), F.col(key)], "_rank")
    first = placed.groupBy("cluster_id").agg(F.min("_rank").alias("_first"))
    return placed.join(first, "cluster_id").withColumn("rank_in_cluster", (F.col("_rank") - F.col("_first") + 1).cast("int")).drop("_rank", "_first")


def mine_pairs(rows: DataFrame, least: float, ratio: tuple[float, float], top: int, most: int, reciprocal: bool = False) -> DataFrame:
    """Pairs of segments of one score, part and split that don't overlap in time, are of like length and similar.

    rows: id, score_id, part_id, split, start_q, end_q, bars, vector. Each segment keeps its `top` most similar ones
    and of those `most`; with reciprocal only pairs that both sides keep. (id_a, id_b, score_id, similarity).

    A group of one score, part, split and step of length is a grid of blocks of GRID rows; blocks meet in pairs, as
    block products of which each row keeps its best, so a group of any size is spread over tasks. Groups of one block
    share a task's grid cell with others. Rows without score, part, split, times, bars or vector are in no pair.
    """
    kept_of = min(top, most)
    need = ["id", "start_q", "end_q", "bars", "vector"]
    fair = rows.select("score_id", "part_id", "split", *need).where(" and ".join(f"{c} is not null" for c in ("score_id", "part_id", "split", *need)))
    # lengths within the ratio lie in the same or in neighbouring steps, so a long score doesn't meet itself as a whole
    step = F.floor(F.ln(F.greatest(F.lit(1e-6), F.col("bars"))) / math.log(max(ratio[1], 1 / ratio[0], 1.01))) if ratio[0] > 0 else F.lit(0)
    group = ["score_id", "part_id", "split", "_step"]
    left = fair.withColumn("_step", step.cast("long"))
    right = left.withColumn("_step", F.explode(F.array(*[F.col("_step") + k for k in ((-1, 0, 1) if ratio[0] > 0 else (0,))])))
    count = lambda side, name: side.groupBy(*group).agg(F.count(F.lit(1)).alias(name))
    # written first, so that the joins below may split the group that most rows share
    sizes = written(count(left, "_n").join(count(right, "_m"), group).select(*group, F.ceil(F.col("_n") / GRID).cast("int").alias("_i"), F.ceil(F.col("_m") / GRID).cast("int").alias("_j"), F.col("_n")), "groups")
    bins = -(-(sizes.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0] or 1) // GRID)
    alone = (F.col("_i") > 1) | (F.col("_j") > 1)
    name = F.xxhash64(*group)
    cell = F.when(alone, name).otherwise(F.pmod(name, F.lit(bins)))
    place = lambda among: F.pmod(F.xxhash64("id", F.lit(7)), F.col(among).cast("long")).cast("int")
    every = lambda among: F.explode(F.sequence(F.lit(0), F.col(among) - 1))
    columns = [*group, *need]
    a = left.join(sizes, group).select(cell.alias("_cell"), alone.alias("_alone"), place("_i").alias("_a"), every("_j").alias("_b"), *columns)
    b = right.join(sizes, group).select(cell.alias("_cell"), alone.alias("_alone"), every("_i").alias("_a"), place("_j").alias("_b"), *[F.col(c).alias(f"{c}_2") for c in columns])
    by = ["_cell", "_alone", "_a", "_b"]
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "score_id")}
    shape = f"id_a {kinds['id']}, id_b {kinds['id']}, score_id {kinds['score_id']}, similarity double, length_ratio double"

    def best(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(x) and len(y):
            y = y.rename(columns=lambda c: c.removesuffix("_2")).sort_values("id", kind="stable")
            codes = pd.factorize(pd.concat([x[group], y[group]]).apply(tuple, axis=1))[0]
            own, other, v = codes[: len(x)], codes[len(x) :], _unit_rows(y["vector"])
            ids, start, end, bars = (y[c].to_numpy() for c in ("id", "start_q", "end_q", "bars"))
            for lo in range(0, len(x), 512):
                p = x.iloc[lo : lo + 512]
                col = lambda c: p[c].to_numpy()[:, None]  # noqa: E731, B023
                share = bars / np.maximum(1e-6, col("bars").astype(float))
                s = np.round(_unit_rows(p["vector"]) @ v.T, 9)
                ok = (own[lo : lo + 512, None] == other) & (col("id") != ids) & ((end <= col("start_q")) | (start >= col("end_q"))) & (share >= ratio[0]) & (share <= ratio[1]) & (s >= least)
                s = np.where(ok, s, -np.inf)
                first = np.argsort(-s, axis=1, kind="stable")[:, :kept_of]
                value = np.take_along_axis(s, first, 1)
                keep = np.isfinite(value)
                n = keep.sum(1)
                out.append(pd.DataFrame({"id_a": np.repeat(p["id"].to_numpy(), n), "id_b": ids[first[keep]], "score_id": np.repeat(p["score_id"].to_numpy(), n), "similarity": value[keep], "length_ratio": np.take_along_axis(share, first, 1)[keep]}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("id_a", "id_b", "score_id", "similarity", "length_ratio")})

    close = a.groupBy(*by).cogroup(b.groupBy(*by)).applyInPandas(best, shape)
    w = Window.partitionBy("id_a").orderBy(F.desc("similarity"), "id_b")
    kept = close.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= kept_of).select("id_a", "id_b", "score_id", "similarity", "length_ratio")
    if reciprocal:
        kept = written(kept, "pairs")
        kept = kept.join(kept.select(F.col("id_a").alias("id_b"), F.col("id_b").alias("id_a")), ["id_a", "id_b"], "left_semi")
    return kept


def symmetric(pairs: DataFrame) -> DataFrame:
    """Each id with the ids it is paired with, from either side."""
    ends = pairs.select("id_a", "id_b").unionByName(pairs.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"))).distinct()
    return ends.groupBy(F.col("id_a").alias("id")).agg(F.array_sort(F.collect_list("id_b")).alias("mates"))


def pair_cosines(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The cosine of each pair's vectors."""
    a = rows.select(F.col("id").alias("id_a"), unit(F.col("vector")).alias("v_a"))
    b = rows.select(F.col("id").alias("id_b"), unit(F.col("vector")).alias("v_b"))
    return pairs.join(a, "id_a").join(b, "id_b").select("id_a", "id_b", dot(F.col("v_a"), F.col("v_b")).alias("cosine"))


def preservation(neighbors: DataFrame, assigned: DataFrame, key: str, n: int = 10, top_tokens: int = 5) -> DataFrame:
    """Per query how many of its n neighbours are among the n rows closest to its own cluster's centroid.

    The same for the n closest rows of the `top_tokens` clusters that hold the closest rows of all. (query_id,
    overlap_same, jaccard_same, overlap_near, jaccard_near)
    """
    one_more = Window.partitionBy("cluster_id").orderBy(F.desc("cosine"), key)
    per = assigned.withColumn("_r", F.row_number().over(one_more)).where(F.col("_r") <= n + 1)
    members = per.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("_r", F.col(key).alias("id")))).getField("id").alias("_same"))
    tops = assigned.groupBy("cluster_id").agg(F.max("cosine").alias("_top")).orderBy(F.desc("_top"), "cluster_id").limit(top_tokens)
    near = per.join(F.broadcast(tops.select("cluster_id")), "cluster_id").orderBy(F.desc("cosine"), key).limit(n + 1)
    near = near.agg(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("_c"), F.col(key).alias("id")))).getField("id").alias("_near"))
    lists = neighbors.groupBy("query_id").agg(F.collect_set("id").alias("_cont"))
    own = lists.join(assigned.select(F.col(key).alias("query_id"), "cluster_id"), "query_id").join(F.broadcast(members), "cluster_id").join(F.broadcast(near))
    for c in ("_same", "_near"):
        own = own.withColumn(c, F.slice(F.filter(F.col(c), lambda x: x != F.col("query_id")), 1, n))
    shared = lambda c: F.size(F.array_intersect("_cont", c))
    jaccard = lambda c: shared(c) / F.greatest(F.lit(1), F.size(F.array_union("_cont", c)))
    return own.select("query_id", shared("_same").alias("overlap_same"), jaccard("_same").alias("jaccard_same"), shared("_near").alias("overlap_near"), jaccard("_near").alias("jaccard_near"))


def preservation_means(preserved: DataFrame) -> DataFrame:
    """The number of queries and the means of preservation(), 0 where there are none; one row."""
    means = [F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("overlap_same", "jaccard_same", "overlap_near", "jaccard_near")]
    return preserved.agg(F.count(F.lit(1)).alias("queries"), *means)


def retrieval_metrics(neighbors: DataFrame, relevant: DataFrame) -> DataFrame:
    """Recall at 1, 5 and 10 and mean reciprocal rank. Queries without a hit count 0.

    relevant: query_id and id, or, where a row is relevant that shares a label, id and label.
    """
    if "label" in relevant.columns:
        of = relevant.select(F.col("id").alias("query_id"), F.col("label").alias("_wanted"))
        found = neighbors.join(relevant.select("id", "label"), "id").join(of, "query_id").where("label = _wanted and id != query_id")
    else:
        found = neighbors.join(relevant, ["query_id", "id"], "left_semi")
    hits = found.groupBy("query_id").agg(F.min("rank").alias("first"))
    of = neighbors.select("query_id").distinct().join(hits, "query_id", "left")
    at = lambda k: F.avg(F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0)))
    return of.agg(F.count(F.lit(1)).alias("queries"), *[at(k).alias(f"recall_{k}") for k in (1, 5, 10)], F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"))


def reranked(neighbors: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """The k best of each query's neighbours by another similarity; scores: query_id, id, second."""
    w = Window.partitionBy("query_id").orderBy(F.desc("second"), "id")
    return neighbors.join(scores, ["query_id", "id"]).withColumn("rerank", F.row_number().over(w)).where(F.col("rerank") <= k).select("query_id", "rerank", "id", "second")


def contrastive_loss(pairs: DataFrame, temperature: float) -> DataFrame:
    """(batch, loss): the symmetric cross-view loss of each batch; pairs: batch, id, and unit views a and b.

    Views meet within their batch only. A batch of more than MOST_IN_BATCH rows is an error.
    """
    largest = pairs.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > MOST_IN_BATCH:
        raise ValueError(f"a batch has {largest} rows; at most {MOST_IN_BATCH}")
    left = pairs.select("batch", F.col("id").alias("i"), unit(F.col("a")).alias("a"))
    right = pairs.select("batch", F.col("id").alias("j"), unit(F.col("b")).alias("b"))
    s = left.join(right, "batch").select("batch", "i", "j", (dot(F.col("a"), F.col("b")) / temperature).alias("s"))
    one = lambda key: s.groupBy("batch", key).agg((F.ln(F.sum(F.exp("s"))) - F.max(F.when(F.col("i") == F.col("j"), F.col("s")))).alias("l")).groupBy("batch").agg(F.avg("l").alias(f"l_{key}"))
    return one("i").join(one("j"), "batch").select("batch", ((F.col("l_i") + F.col("l_j")) / 2).alias("loss"))
