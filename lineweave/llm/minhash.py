"""MinHash near-duplicates with circulant signatures, banding and exact Jaccard verification.

One permutation of the 32-bit universe scrambles the shingles, a second one, circularly shifted by 1..K, gives all K
signature coordinates (both are bijective mixers, so nothing of the universe's size is stored). Bands of coordinates
make buckets. In each bucket texts are verified against a centre rather than against each other; as long as a bucket
holds texts of different components, texts of its smaller components become centres too. So each pair of a bucket
either was compared on full sets or is known to be connected: no link between components is lost, and a group of g
near copies costs g comparisons, not g * g.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.llm.common import buffers, dropped, flat, lists, mix, steps, whole_ids, written
from lineweave.llm.components import components
from lineweave.llm.words import shingle_set, words

#: A pair at the threshold shares no bucket with at most this probability.
MISS = 1e-6
ROWS = 4
#: 64-bit words of a set's parity sketch.
SKETCH = 8


def bands_for(similarity: float, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - similarity**rows))


def _scramble(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A bijection of 32-bit values."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(a)
    x ^= x >> np.uint32(15)
    x *= np.uint32(b)
    x ^= x >> np.uint32(16)
    return x


def signature(s: np.ndarray, k: int) -> np.ndarray:
    """Circulant MinHash of a non-empty shingle set: coordinate i is the least pi(sigma(x) - i)."""
    at = _scramble((s >> np.uint64(32)).astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    out = np.full(k, 0xFFFFFFFF, np.uint32)
    shift = np.arange(1, k + 1, dtype=np.uint32)[:, None]
    for lo in range(0, len(at), 4096):
        out = np.minimum(out, _scramble(at[None, lo : lo + 4096] - shift, 0x21F0AAAD, 0x735A2D97).min(axis=1))
    return out


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    n = len(sig) // rows
    part = sig[: n * rows].reshape(n, rows).astype(np.uint64)
    key = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(rows):
        key = mix(key ^ part[:, j])
    return key


def odd_sketch(s: np.ndarray) -> np.ndarray:
    """SKETCH * 64 bits, each the parity of the shingles it stands for: sketches differ in at most |A ^ B| bits."""
    bit = (s & np.uint64(SKETCH * 64 - 1)).astype(np.int64)
    odd = (np.bincount(bit, minlength=SKETCH * 64) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, n_bands: int, rows: int = ROWS) -> DataFrame:
    """One row per row of docs: id, mark, n_shingles, digest, bands, sketch.

    mark is a hash of the text, which tells texts of one id apart; digest 16 bytes that tell sets apart, null for an
    empty set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffers(batch.column(1))
            n_set, digest, keys, odd = np.zeros(len(batch), np.int64), [], [], []
            for lo, hi in steps(off):
                h, _, _, first = words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                for i in range(lo, hi):
                    s = shingle_set(h[first[i - lo] : first[i - lo + 1]], width)
                    n_set[i] = len(s)
                    if len(s):
                        digest.append(np.array([mix(s).sum(), mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()], np.uint64).tobytes())
                        keys.append(band_keys(signature(s, n_bands * rows), rows))
                        odd.append(odd_sketch(s))
                    else:
                        digest.append(None)
            yield pa.record_batch(
                [batch.column(0), batch.column(2), flat(n_set, pa.int64()), flat(digest, pa.binary()), lists(np.concatenate(keys or [np.zeros(0, np.uint64)]).view(np.int64), np.where(n_set > 0, n_bands, 0), pa.int64()), lists(np.concatenate(odd or [np.zeros(0, np.int64)]), np.where(n_set > 0, SKETCH, 0), pa.int64())],
                names=["id", "mark", "n_shingles", "digest", "bands", "sketch"],
            )

    rows_ = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), _mark(text_col).alias("mark"))
    return rows_.mapInArrow(run, "id long, mark long, n_shingles long, digest binary, bands array<long>, sketch array<long>")


def _mark(text_col: str) -> Column:
    return F.xxhash64(F.col(text_col).cast("string"))


def sets(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, shingles) with each text's full set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffers(batch.column(1))
            for lo, hi in steps(off):
                h, _, _, first = words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                own = [shingle_set(h[first[i] : first[i + 1]], width) for i in range(hi - lo)]
                yield pa.record_batch(
                    [batch.column(0).slice(lo, hi - lo), lists(np.concatenate(own).view(np.int64), np.array([len(x) for x in own]), pa.int64())], names=["id", "shingles"]
                )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "id long, shingles array<long>")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 85) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Texts are linked when 100 * |A & B| >= percent * |A | B| on their sets of `width`-word shingles. component_id is
    the smallest id reachable over links, the own id included. A null or empty text, or one without words, has an
    empty set and is linked with nothing; a text of fewer words than `width` has its whole sequence as one shingle.
    Rows with equal sets are linked whatever their number. A null id is never linked: component_id null, kept true.
    Rows that repeat an id each get a row, by their own text. Ids of another kind than whole numbers are an error. Only
    the two named columns are read; an empty table gives no rows.
    """
    return _rows(docs, id_col, text_col, width, percent).select(
        F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.expr("id <=> component").alias("kept")
    )


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows that near_duplicates() doesn't keep; all columns stay as they are, whatever their names.

    Of rows that repeat an id each goes or stays by its own text; rows that repeat id and text do so together.
    """
    own_id, own_mark = (f"{x}-{uuid.uuid4().hex}" for x in ("id", "mark"))  # no column of docs has such a name
    gone = _rows(docs, id_col, text_col, width, percent).where("not id <=> component").select(F.col("id").alias(own_id), F.col("mark").alias(own_mark)).distinct()
    same = (docs[id_col] == gone[own_id]) & (F.xxhash64(docs[text_col].cast("string")) == gone[own_mark])
    return docs.join(gone.hint("merge"), same, "left_anti")


def _rows(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """One row per row of docs: id, mark, n_shingles, component."""
    whole_ids(docs, id_col)
    n_bands = bands_for(percent / 100)
    signed = written(signatures(docs, id_col, text_col, width, n_bands), "signatures")
    usable = signed.where("id is not null and digest is not null")
    first = F.min(F.struct("id", "mark")).alias("first")
    items = usable.groupBy("digest").agg(first, F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    items = written(items.select("digest", "first.*", "n", "bands", "sketch").withColumn("item", F.monotonically_increasing_id()), "items")
    members = items.select(F.explode("bands").alias("bucket"), "item")
    bucket = written(members.groupBy("bucket").agg(F.min("item").alias("centre"), F.max("item").alias("last")).where("centre != last").select("bucket", "centre"), "buckets")
    members = written(members.join(bucket.select("bucket"), "bucket", "left_semi"), "members")
    wanted = items.select("item", "id", "mark").join(members.select("item").distinct(), "item", "left_semi")
    # merged by sorting at any size: the texts' side is too large to copy the other one to each task
    text = docs.select(F.col(id_col).cast("long").alias("id"), _mark(text_col).alias("mark"), F.col(text_col).cast("string").alias("text"))
    full = text.join(wanted.hint("merge"), ["id", "mark"]).dropDuplicates(["id", "mark"])  # already dealt by these
    shingled = written(sets(full, "item", "text", width).select(F.col("id").alias("item"), "shingles"), "sets")

    # First each text against one centre only, the smallest of its buckets' centres: that joins most of each group.
    best = members.join(bucket, "bucket").where("item != centre").groupBy("item").agg(F.min("centre").alias("centre"))
    links = written(_verified(best.select(F.greatest("item", "centre").alias("a"), F.least("item", "centre").alias("b")).distinct(), shingled, percent), "verified")
    label = written(components(links), "labels")
    centres, done, batch = bucket, None, 1
    while True:
        mixed = _mixed(_label(members, "item", label, "c"))
        left, members = members, written(members.join(mixed.select("bucket"), "bucket", "left_semi"), "members")
        dropped(docs.sparkSession, left)
        if members.isEmpty():
            break
        placed = _label(members, "item", label, "c")
        if done is not None:
            centres = _next_centres(placed.join(mixed, "bucket").where("c != largest"), done, batch)
            if centres.isEmpty():
                break
        done = centres if done is None else written(done.unionByName(centres), "centres")
        found = written(_verified(_open_pairs(placed, centres, items, percent), shingled, percent), "verified")
        links = links.unionByName(found)
        if not found.isEmpty():
            label = written(components(links), "labels")
        batch *= 4
    for table in (members, bucket, shingled):
        dropped(docs.sparkSession, table)

    own = written(_label(items.select("digest", "id", "item"), "item", label, "c").select("digest", "id", "c"), "own")
    dropped(docs.sparkSession, items)
    own = own.select("digest", "c").join(own.groupBy("c").agg(F.min("id").alias("component")), "c").select("digest", "component")
    rows = signed.select("id", "mark", "n_shingles", "digest")
    both = rows.where("id is not null and digest is not null").join(own, "digest").select("id", "mark", "n_shingles", "component")
    return both.unionByName(rows.where("id is null or digest is null").select("id", "mark", "n_shingles", F.col("id").alias("component")))


def _label(table: DataFrame, column: str, label: DataFrame, name: str) -> DataFrame:
    """Adds the component of an item column; an item without an entry is its own."""
    own = label.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    return table.join(own, table[column] == own._node, "left").withColumn(name, F.coalesce("_component", column)).drop("_node", "_component")


def _verified(pairs: DataFrame, shingled: DataFrame, percent: int) -> DataFrame:
    left = shingled.select(F.col("item").alias("a"), F.col("shingles").alias("s_a"))
    right = shingled.select(F.col("item").alias("b"), F.col("shingles").alias("s_b"))
    both = pairs.join(left, "a").join(right, "b")
    both = both.select("a", "b", F.size("s_a").alias("n_a"), F.size("s_b").alias("n_b"), F.size(F.array_intersect("s_a", "s_b")).alias("shared"))
    return both.where(F.expr(f"100L * shared >= {percent}L * (n_a + n_b - shared)")).select("a", "b").distinct()


def _mixed(placed: DataFrame) -> DataFrame:
    """(bucket, largest): the buckets with texts of several components, and the one with most of them."""
    size = placed.groupBy("bucket", "c").agg(F.count(F.lit(1)).alias("size"))
    mixed = size.groupBy("bucket").agg(F.max(F.struct("size", "c")).alias("most"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    return written(mixed.select("bucket", F.col("most.c").alias("largest")), "mixed")


def _next_centres(minor: DataFrame, done: DataFrame, batch: int) -> DataFrame:
    """Up to `batch` texts per bucket that weren't a centre there; minor: those not of its largest component."""
    left = minor.select("bucket", F.col("item").alias("centre")).join(done, ["bucket", "centre"], "left_anti")
    order = Window.partitionBy("bucket").orderBy("centre")
    return written(left.withColumn("k", F.row_number().over(order)).where(F.col("k") <= batch).select("bucket", "centre"), "centres")


def _open_pairs(placed: DataFrame, centres: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """Pairs of a bucket's centres and texts of other components that sizes and sketches don't rule out.

    A link means |A ^ B| <= (100 - percent) / (100 + percent) * (|A| + |B|), and sketches never differ in more.
    """
    keys = [f"k{i}" for i in range(SKETCH)]
    about = items.select("item", "n", *[F.col("sketch")[i].alias(k) for i, k in enumerate(keys)])
    wide = placed.join(about, "item")
    lead = centres.join(wide.withColumnRenamed("item", "centre"), ["bucket", "centre"])
    lead = lead.select("bucket", "centre", F.col("c").alias("c2"), F.col("n").alias("n2"), *[F.col(k).alias(f"{k}_2") for k in keys])
    differ = " + ".join(f"bit_count({k} ^ {k}_2)" for k in keys)
    may = f"c != c2 and 100 * least(n, n2) >= {percent} * greatest(n, n2) and {100 + percent} * ({differ}) <= {100 - percent} * (n + n2)"
    found = wide.join(lead, "bucket").where(f"item != centre and {may}")
    return found.select(F.greatest("item", "centre").alias("a"), F.least("item", "centre").alias("b")).distinct()
