"""Language identification by nearest centroid.

A text becomes the normalised TF-IDF vector of its hashed byte trigrams (of the lower-cased text; ASCII characters
other than letters count as spaces). Each language has several centroids from spherical k-means; the language of the
centroid with the largest cosine wins, and a text whose best cosine lies below that language's own threshold is
rejected as too far from everything learned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineweave.llm.common import buffers, crc_mod, flat, lists, steps, written

DIMS = 4096
#: Sampled ids that may travel to all tasks.
FEW = 50_000
#: The share of a language's own texts that its threshold is measured at.
FIRST = 0.01
#: Distinct trigrams from which on a text's cosine is held against the full threshold.
FULL = 256
_LETTER = np.arange(256, dtype=np.uint32)
_LETTER[:128] = [c if chr(c).isalpha() else 32 for c in range(128)]


@dataclass(frozen=True)
class Model:
    """idf: a weight per bucket. centroids: unit rows, `language` naming each one's. threshold: per centroid."""

    idf: np.ndarray
    centroids: np.ndarray
    language: list[str]
    threshold: np.ndarray


def counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """log(1 + count) of each text's trigrams in DIMS buckets; grams of spaces only count for nothing."""
    n = len(off) - 1
    if len(data) < 3:
        return np.zeros((n, DIMS), np.float32)
    x = _LETTER[data]
    code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    row = np.repeat(np.arange(n), np.diff(off))
    ok = (row[:-2] == row[2:]) & (code != 0x202020)
    bucket = (code[ok] * np.uint32(0x9E3779B1)) >> np.uint32(20)
    return np.log1p(np.bincount(row[:-2][ok] * DIMS + bucket, minlength=n * DIMS).reshape(n, DIMS)).astype(np.float32)


def _features(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, int, np.ndarray]]:
    data, off = buffers(batch.column(k))
    for lo, hi in steps(off, 1 << 19):
        for a in range(lo, hi, 256):  # many short texts: bounded rows of the dense matrix
            b = min(a + 256, hi)
            yield a, b, counts(data[off[a] : off[b]], off[a : b + 1] - off[a])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _spherical(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means of unit rows, seeded by farthest points from the mean on; deterministic."""
    seeds = [int(np.argmax(x @ _unit(x.mean(0, keepdims=True))[0]))]
    best = x @ x[seeds[0]]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(np.argmin(best)))
        best = np.maximum(best, x @ x[seeds[-1]])
    c = x[seeds]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        c = np.stack([_unit(x[own == j].sum(0, keepdims=True))[0] if (own == j).any() else c[j] for j in range(len(c))])
    return c


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """The number of texts (one column, lower-cased) and how many of them hold each bucket; DIMS + 1 rows a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(DIMS + 1, np.int64)
        for batch in batches:
            sums[DIMS] += len(batch)
            for _, _, x in _features(batch, 0):
                sums[:DIMS] += np.count_nonzero(x, axis=0)
        some = np.flatnonzero(sums)
        yield pa.record_batch([flat(some, pa.int64()), flat(sums[some], pa.int64())], names=["at", "n"])

    got = texts.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros(DIMS + 1, np.int64)
    sums[got["at"].to_numpy()] = got["n"].to_numpy()
    return int(sums[DIMS]), sums[:DIMS]


def train(docs: DataFrame, label_col: str, text_col: str, key: str, centroids: int = 4, per_slot: int = 24, slots: int = 16, far: float = 0.5) -> Model:
    """Fit on at most slots * per_slot labelled texts per language, spread over `slots` by a hash of the key.

    The bound (384 a language by default) is a parameter and holds for centroids and thresholds, also where rows
    repeat an id; each language is fitted in a task of its own. The IDF counts all labelled texts. Texts that are null or without a letter are left out. A
    language's rejection threshold is `far` times the first percentile of its own texts' best cosines; for a text of
    fewer than FULL distinct trigrams, whose cosines are small by nature, it shrinks with the root of their number.
    """
    usable = docs.where(F.col(label_col).isNotNull() & F.col(key).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    order = Window.partitionBy("label", "slot").orderBy("place", "id")
    chosen = (
        usable.select(F.col(key).alias("id"), F.col(label_col).alias("label"), F.xxhash64(F.col(key).cast("string")).alias("place"))
        .withColumn("slot", F.pmod("place", F.lit(slots)))
        .withColumn("k", F.row_number().over(order))
        .where(F.col("k") <= per_slot)
        .select("id")
        .distinct()
    )
    chosen = written(chosen, "sample")
    if chosen.count() <= FEW:  # slots * per_slot a language: with more languages than FEW allows, texts are shuffled
        chosen = F.broadcast(chosen)
    n, held = document_frequencies(usable.select(F.lower(text_col)))
    idf = np.log((1 + n) / (1 + held)).astype(np.float32) + 1

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, x in _features(batch, 2):
                rows, cols = np.nonzero(x)
                n = np.bincount(rows, minlength=hi - lo)
                yield pa.record_batch([*(batch.column(k).slice(lo, hi - lo) for k in (0, 1, 3)), lists(cols.astype(np.int16), n, pa.int16()), lists(x[rows, cols], n, pa.float32())], names=["place", "label", "text_hash", "at", "value"])

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["place", "text_hash"], kind="mergesort")
        x = np.zeros((len(pdf), DIMS), np.float32)
        for i, (at, value) in enumerate(zip(pdf["at"], pdf["value"], strict=True)):
            x[i, at] = value
        own = _unit(x * idf)
        c = _spherical(own, centroids)
        limit = far * float(np.quantile((own @ c.T).max(1), FIRST))
        return pd.DataFrame({"label": pdf["label"].iloc[0], "centroid": list(c), "threshold": limit})

    # an id may stand for many rows, so the rows themselves are bounded as well
    sample = usable.select(F.col(key).alias("id"), F.col(label_col).alias("label"), F.lower(text_col).alias("text")).join(chosen, "id", "left_semi")
    sample = sample.withColumn("place", F.xxhash64(F.col("id").cast("string"))).withColumn("slot", F.pmod("place", F.lit(slots))).withColumn("text_hash", F.xxhash64("text"))
    few = sample.withColumn("k", F.row_number().over(Window.partitionBy("label", "slot").orderBy("place", "text_hash"))).where(F.col("k") <= per_slot)
    made = few.select("place", "label", "text", "text_hash").mapInArrow(vectors, "place long, label string, text_hash long, at array<short>, value array<float>")
    made = made.groupBy("label").applyInPandas(fitted, "label string, centroid array<float>, threshold double").toPandas()  # centroids a language
    made = made.sort_values("label", kind="mergesort")
    rows = np.stack([np.zeros(DIMS, np.float32), *made["centroid"]])[1:]
    return Model(idf, rows, made["label"].tolist(), made["threshold"].to_numpy(float))


def _nearest(x: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's nearest centroid, its cosine, and whether it is near enough."""
    cos = _unit(x * model.idf) @ model.centroids.T
    best = np.argmax(cos, axis=1)
    cosine = np.clip(cos[np.arange(len(x)), best], 0, 1)
    return best, cosine, cosine >= model.threshold[best] * np.sqrt(np.minimum((x > 0).sum(1) / FULL, 1))


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the key, lang_pred, score (best cosine, 0 to 1) and rejected.

    A null or empty text and one without a letter are `und`, score 0, rejected; so is everything if nothing was
    learned. Ties go to the language first in alphabetical order. Only the two named columns are read; repeated rows
    each get a row; an empty table gives none.
    """
    names = pa.array(model.language or ["und"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            best, cosine, near = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, bool)
            if model.language:
                for lo, hi, x in _features(batch, 1):
                    best[lo:hi], cosine[lo:hi], near[lo:hi] = _nearest(x, model)
            known = batch.column(2).to_numpy(zero_copy_only=False).astype(bool) & bool(model.language)
            lang = pa.array(np.where(known, names.to_numpy(zero_copy_only=False)[best], "und"), pa.string())
            score = np.where(known, cosine, 0.0)
            yield pa.record_batch([batch.column(0), lang, flat(score, pa.float64()), flat(~(known & near), pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    text = docs.select(F.col(key).alias("doc_id"), F.lower(text_col), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    kind = docs.schema[key].dataType.simpleString()
    return text.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def without_rejected(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without the rows that predict() would reject; all columns stay as they are, whatever their names."""
    columns, width = docs.columns, len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = batch.column(width + 1).to_numpy(zero_copy_only=False).astype(bool) & bool(model.language)
            if keep.any():
                for lo, hi, x in _features(batch, width):
                    keep[lo:hi] &= _nearest(x, model)[2]
            yield pa.RecordBatch.from_arrays(batch.columns[:width], names=columns).filter(pa.array(keep))

    extra = [F.lower(docs[text_col]).alias("_lower"), F.coalesce(docs[text_col].rlike(r"\p{L}"), F.lit(False)).alias("_letter")]
    return docs.select(*[docs[c] for c in docs.columns], *extra).mapInArrow(run, docs.schema)


def identify(docs: DataFrame, folds: int = 3, held_out: int = 1) -> DataFrame:
    """Learn from documents whose crc32(doc_id) modulo `folds` isn't `held_out`, predict all: adds held_out to predict()."""
    model = train(docs.where(crc_mod("doc_id", folds) != held_out), "lang", "text", "doc_id")
    out = predict(docs, model)
    return out.withColumn("held_out", F.coalesce(crc_mod("doc_id", folds) == held_out, F.lit(False)))
