"""The engine's commands as functions from tables to tables (survey 2.14, 3.1-3.4)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.config import DEFAULTS
from lineweave.functions.expressions import hash_split, quality, segment_id, valid_vector
from lineweave.operators import catalog as C
from lineweave.operators import ann, codebook, dataset, diagnostics, features, moments, reviews, segment, sequences, vectors
from lineweave.operators import notes as N
from lineweave.operators.ranks import quantiles

_LINE = ["score_id", "part_id", "line_id"]


def select_scores(catalog: DataFrame, cfg: dict[str, Any] = DEFAULTS) -> DataFrame:
    """Catalog to chosen scores: named subset, then a bounded sample."""
    c = cfg["catalog"]
    chosen = C.subset(catalog, c["subset"], "mxl")
    worth = quality(F.col("rating"), F.col("n_views"), F.col("n_favorites"), F.col("n_ratings"))
    return C.sampled(chosen, c["sampling"], c["max_scores"], "score_id", worth, c["seed"])


def extract_segments(notes: DataFrame, catalog: DataFrame | None = None, cfg: dict[str, Any] = DEFAULTS) -> DataFrame:
    """Notes (score_id, part_id, voice_id, percussion, o, p, d, tie, measure) to segments with their notes.

    Lines, evidence, cuts and rows of segments; a note that begins at a cut belongs to both neighbours. With a catalog
    its description joins each segment.
    """
    s = cfg["segmentation"]
    lines = N.lines(notes, ["score_id", "part_id"], cfg["extraction"]["min_notes_per_line"])
    measures = notes.groupBy("score_id", "part_id", "o").agg(F.min("measure").alias("measure"))
    placed = lines.join(measures, ["score_id", "part_id", "o"], "left").withColumn("line", F.concat_ws("|", *_LINE))
    line = N.Line(["line"])
    key = N.key_of(placed, line)
    keyed = placed.join(key, "line")
    evidence = N.boundary_evidence(keyed, line, cfg["boundary_weights"], F.col("tonic")).select("line", F.round("o", 6).alias("t"), "evidence")
    times = N.candidate_times(placed, line).join(evidence, ["line", "t"], "left").groupBy("line").agg(F.array_sort(F.collect_list(F.struct("t", F.coalesce("evidence", F.lit(0.0)).alias("e")))).alias("c"))
    onsets = placed.groupBy("line").agg(F.array_sort(F.collect_list("o")).alias("onsets"))
    lengths = N.measure_length(placed, line)
    cut_input = times.join(onsets, "line").join(lengths, "line").select("line", "measure_length", F.col("c.t").alias("times"), F.col("c.e").alias("evidence"), "onsets")
    cuts = segment.segment_lines(cut_input, "line", segment.Limits(**s))
    inside = placed.join(cuts.select("line", "start_q", "end_q", "n_bars"), "line").where("o >= start_q - 1e-6 and o < end_q + 1e-6")
    packed = inside.groupBy("line", *_LINE, "extraction_mode", "start_q", "end_q", "n_bars").agg(
        F.array_sort(F.collect_list(F.struct((F.col("o") - F.col("start_q")).alias("o"), "p", "d"))).alias("_n"), F.min("measure").alias("start_measure"), F.max("measure").alias("end_measure")
    )
    out = packed.join(key, "line").withColumn("notes", F.transform("_n", lambda n: F.struct(n.p.alias("p"), n.o.alias("o"), n.d.alias("d"), F.lit(80).alias("v"))))
    out = out.withColumn("n_notes", F.size("notes")).withColumn("segment_id", segment_id(F.col("score_id"), F.col("part_id"), F.col("line_id"), F.col("start_q"), F.col("end_q"))).drop("_n", "line")
    return out if catalog is None else out.join(catalog.drop("n_notes"), "score_id", "left")


def extraction_summary(segments: DataFrame) -> DataFrame:
    """A1: counts, medians and shares of modes; one row."""
    per = segments.groupBy("score_id").agg(F.count(F.lit(1)).alias("k"))
    own = segments.agg(F.count(F.lit(1)).alias("segments"), F.avg((F.col("extraction_mode") == "explicit_voice").cast("double")).alias("explicit_share"))
    each = [quantiles(segments, "n_bars", {"median_bars": 0.5}), per.agg(F.count(F.lit(1)).alias("scores")), quantiles(per, "k", {"median_per_score": 0.5})]
    return reduce(lambda a, b: a.join(F.broadcast(b)), each, own).select("segments", "median_bars", "explicit_share", "scores", "median_per_score")  # one row each


def build_embeddings(segments: DataFrame, key: str = "segment_id") -> dict[str, DataFrame]:
    """Features of three spaces, standardised and normalised: (key, embedding) by space."""
    made = features.assembled(segments)
    out = {}
    for space in ("melody", "rhythm", "combined"):
        z = features.standardized(made, key, space).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "z"))).getField("z").alias("v"))
        out[space] = z.select(key, vectors.unit(F.col("v")).alias("embedding"))
    return out


def inspect(segments: DataFrame, embeddings: DataFrame, ids: list, k: int = 3) -> DataFrame:
    """The k nearest segments of other scores for a few segments, with what a reader needs to compare them."""
    about = segments.select(F.col("segment_id").alias("id"), "score_id", F.col("n_bars").alias("bars"))
    rows = embeddings.select(F.col("segment_id").alias("id"), F.col("embedding").alias("vector")).join(about, "id")
    return vectors.nearest(rows, rows.where(F.col("id").isin(ids)), k).join(about, "id")


def eligible_segments(segments: DataFrame, spaces: dict[str, DataFrame], least: int = 4, most: int = 96, bars: tuple[float, float] = (1.0, 12.0)) -> DataFrame:
    """Licensed explicit lines of fair length with a usable vector in every space, each segment once."""
    keep = segments.where(F.col("license") & (F.col("extraction_mode") == "explicit_voice") & F.size("notes").between(least, most) & F.col("n_bars").between(*bars))
    keep = C.first_per_key(keep, ["segment_id"], [F.col("score_id"), F.col("start_q")])
    for v in spaces.values():
        keep = keep.join(v.where(valid_vector(F.col("embedding"))).select("segment_id"), "segment_id", "left_semi")
    if keep.isEmpty():
        raise ValueError("no segment is eligible: check license, mode, lengths and vectors")
    return keep


def prepare_encoder_data(segments: DataFrame, **how) -> dict[str, DataFrame]:
    """Eligible and rejected segments and a summary of the splits."""
    p = dataset.prepared(segments, **{"least": 4, "most": 96, "min_bars": 1.0, "max_bars": 12.0} | how)
    good = p.where("reason is null")
    return {"eligible": good, "rejected": p.where("reason is not null").select("segment_id", "reason"), "splits": good.groupBy("split").agg(F.count(F.lit(1)).alias("segments"), F.countDistinct("score_id").alias("scores"))}


def mine_encoder_positives(rows: DataFrame, least: float = 0.92, ratio: tuple[float, float] = (0.75, 1.33), top: int = 10, most: int = 5, reciprocal: bool = False) -> DataFrame:
    return vectors.mine_pairs(rows, least, ratio, top, most, reciprocal)


def build_learned_index(rows: DataFrame, encoder: Callable[[list], np.ndarray], seed: int = 42) -> DataFrame:
    """(segment_id, score_id, split, embedding) of a pluggable encoder."""
    made = dataset.encoded(rows, "segment_id", "tokens", encoder)
    return rows.select("segment_id", "score_id", hash_split(seed, F.col("score_id"), 0.8, 0.1).alias("split")).join(made, "segment_id")


def save_learned_index(rows: DataFrame, encoder: Callable[[list], np.ndarray], path: str, seed: int = 42, **how) -> ann.Index:
    """The embeddings with score and split as a saved neighbour index; its manifest names rows and recall."""
    made = build_learned_index(rows, encoder, seed).select(F.col("segment_id").alias("id"), F.col("embedding").alias("vector"), "score_id", "split")
    return ann.build(made, path, seed=seed, keep=["score_id", "split"], **how)


def evaluate_backends(backends: dict[str, DataFrame], queries: int = 50, k: int = 10) -> DataFrame:
    """The neighbours of the same evenly spaced queries under each backend: backend, query_id, rank, id."""
    out = None
    for name, rows in backends.items():
        chosen = C.evenly_spaced(rows, [F.col("id")], queries) if "segment_id" not in rows.columns else C.fixed_queries(rows, queries)
        one = vectors.nearest(rows, chosen, k).withColumn("backend", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def summarize_encoder_evaluation(votes: DataFrame) -> DataFrame:
    """By run, over the earliest vote per run and query; votes: the review schema with an ordinal."""
    first = reviews.earliest(votes, ["run_id", "query_segment_id"], "timestamp", "ordinal")
    return reviews.vote_summary(first.withColumn("won", F.col("winner_backend") == "learned"), ["run_id"])


def evaluate_encoder(rows: DataFrame, positives: DataFrame, label: str = "score_id", k: int = 10) -> dict[str, DataFrame]:
    """Recall, reciprocal rank and cosine of held-out positive pairs, and whether the embeddings have collapsed.

    rows: id, vector and the label; positives: id_a, id_b. Pairs of ids that rows doesn't hold count for nothing.
    """
    both = positives.unionByName(positives.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"))).distinct()
    known = both.join(rows.select(F.col("id").alias("id_a")), "id_a", "left_semi").join(rows.select(F.col("id").alias("id_b")), "id_b", "left_semi")
    asked = rows.join(known.select(F.col("id_a").alias("id")).distinct(), "id", "left_semi")
    neighbors = vectors.nearest(rows, asked, k, other_score=False)
    cosines = vectors.pair_cosines(positives, rows).agg(F.count(F.lit(1)).alias("pairs"), F.avg("cosine").alias("positive_cosine"))
    retrieval = vectors.retrieval_metrics(neighbors, known.select(F.col("id_a").alias("query_id"), F.col("id_b").alias("id")))
    return {"retrieval": retrieval.join(F.broadcast(cosines)), "collapse": moments.collapse(rows, "id", "vector", label)}  # one row each


def evaluate_vocabulary(rows: DataFrame, assigned: DataFrame, queries: int = 100, n: int = 10) -> dict[str, DataFrame]:
    """How far a codebook keeps the neighbours of evenly spaced queries; assigned: id, cluster_id, cosine."""
    chosen = C.evenly_spaced(rows, [F.col("id")], queries)
    kept = vectors.preservation(vectors.nearest(rows, chosen, n, other_score=False), assigned, "id", n)
    return {"queries": kept, "means": vectors.preservation_means(kept)}


def summarize_vocabulary_evaluation(ratings: DataFrame, trials: DataFrame) -> dict[str, DataFrame]:
    """Ratings of clusters and blind trials, of each token and trial the earliest entry, and their joint status.

    ratings: timestamp, token, rating; trials: timestamp, trial_id, same_cluster_won, tie, neither; both with an ordinal.
    """
    own = reviews.review_summary(reviews.earliest(ratings, ["token"], "timestamp", "ordinal"))
    blind = reviews.trial_summary(reviews.earliest(trials, ["trial_id"], "timestamp", "ordinal"))
    return {"reviews": own, "trials": blind, "combined": reviews.combined_status(own, blind)}


def build_vocabulary(rows: DataFrame, sizes: list[int], prefix: str = "M") -> dict[int, dict]:
    return {k: codebook.build(rows, "id", "vector", k, prefix) for k in sizes}


def export_tokens(melody: DataFrame, rhythm: DataFrame, combined: DataFrame, about: DataFrame) -> dict[str, DataFrame]:
    """Tokens of segments, their sequences, transitions, joint statistics and concentration."""
    tokens = sequences.exported(melody, rhythm, combined, about, "segment_id")
    keys = ["score_id", "part_id", "voice_id"]
    big = {s: sequences.transitions(sequences.ngrams(tokens, keys, ["start_q", "segment_id"], f"{s}_token", 2)) for s in ("melody", "rhythm")}
    return {
        "tokens": tokens, "sequences": sequences.collected(tokens, keys, ["start_q", "segment_id"], ["segment_id", "melody_token", "rhythm_token", "start_q", "end_q"]),
        "melody_transitions": big["melody"], "rhythm_transitions": big["rhythm"], "trigrams": sequences.ngrams(tokens, keys, ["start_q", "segment_id"], "melody_token", 3),
        "joint": diagnostics.joint_stats(tokens, "melody_token", "rhythm_token")["summary"], "concentration": diagnostics.concentration(tokens, "melody_token", "score_id", "composer_name"),
    }


def compare_vocabulary_sizes(assignments: dict[int, DataFrame], key: str = "id") -> dict[str, DataFrame | None]:
    """One row per size, and how each size's clusters fall into the next one's."""
    sizes = sorted(assignments)
    one = lambda k: diagnostics.cohesion(assignments[k]).select(F.lit(k).alias("k"), "quantization_error", "mean_margin")
    table = one(sizes[0])
    for k in sizes[1:]:
        table = table.unionByName(one(k))
    steps = None
    for a, b in zip(sizes, sizes[1:], strict=False):
        step = diagnostics.multi_resolution(assignments[a].withColumnRenamed("cluster_id", "parent"), assignments[b].withColumnRenamed("cluster_id", "child"), key, "parent", "child").withColumn("parent_k", F.lit(a))
        steps = step if steps is None else steps.unionByName(step)
    return {"sizes": diagnostics.compared(table, "k", "quantization_error"), "steps": steps}


def vocabulary_report(assigned: DataFrame, key: str = "id", bins: int = 20) -> dict[str, DataFrame]:
    """What a report of a codebook shows: largest clusters, extremes of members, histograms."""
    size = assigned.groupBy("token").agg(F.count(F.lit(1)).alias("size"))
    return {
        "largest": size.orderBy(F.desc("size"), "token").limit(20), "nearest": dataset.members(assigned, "centroid-nearest", 3, key), "doubtful": dataset.members(assigned, "low-confidence", 3, key),
        "random": dataset.members(assigned, "random", 5, key), "cosine": diagnostics.histogram(assigned, F.col("cosine"), bins), "margin": diagnostics.histogram(assigned, F.col("margin"), bins), "sizes": diagnostics.histogram(size, F.col("size"), bins),
    }
