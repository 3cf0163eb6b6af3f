"""Packing documents into fixed-length sequences by cutting-stock column generation.

Texts are tokenised once; a document above the sequence length is cut into full pieces and a rest. Piece lengths,
rounded up to UNIT tokens, make a histogram of at most length / UNIT classes, which is all the driver sees. On it the
linear program of the cutting-stock problem is solved over patterns (how many pieces of each class share a sequence):
a revised simplex method holds the basis, and a knapsack by dynamic programming prices new patterns. Rounded patterns
get consecutive sequence numbers, and each class's pieces, ranked, are dealt to the patterns' places in that order.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
import tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineweave.llm.common import buffers, flat, steps, written

UNIT = 8
#: Relative distance from the linear program's bound at which no more patterns are generated.
GAP = 1e-4


class Tokenizer:
    """Ids as the `tokenizers` library gives them for a byte-level BPE file.

    The same vocabulary and merges run in tiktoken's core, which is five times faster and gives equal ids (tested);
    a text that holds a string of an added token goes to `tokenizers` itself.
    """

    _loaded: dict[str, Tokenizer] = {}

    @classmethod
    def load(cls, path: str) -> Tokenizer:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True) or spec["normalizer"]:
            raise ValueError("only a plain byte-level BPE vocabulary is supported")
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        self.added = [t["content"] for t in spec["added_tokens"]]
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in self.added}
        # the fixed pattern of byte-level pre-tokenisation
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self.core = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.library = tokenizers.Tokenizer.from_file(path)

    def ids(self, text: str) -> np.ndarray:
        if any(a in text for a in self.added):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
        return self.core.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)


def pieces(docs: DataFrame, path: str, end_id: int, length: int, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens. A null text counts as empty: the end id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = Tokenizer.load(path), np.array([end_id], "<u4")
        for batch in batches:
            data, off = buffers(batch.column(1))
            row, start, size, crc, whole = [], [], [], [], []
            for lo, hi in steps(off):
                raw = data[off[lo] : off[hi]].tobytes()
                at = (off[lo : hi + 1] - off[lo]).tolist()
                for i in range(hi - lo):
                    ids = np.concatenate([tok.ids(raw[at[i] : at[i + 1]].decode("utf-8", "replace")), end])
                    for s in range(0, len(ids), length):
                        part = ids[s : s + length]
                        row.append(lo + i)
                        start.append(s)
                        size.append(len(part))
                        crc.append(zlib.crc32(part))
                        whole.append(len(ids))
            yield pa.record_batch(
                [batch.column(0).take(flat(row, pa.int64())), *(flat(x, pa.int64()) for x in (start, size, crc, whole))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            )

    return docs.select(F.col(key), F.col(text_col).cast("string")).mapInArrow(
        run, f"doc_id {docs.schema[key].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long"
    )


def knapsack(value: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Best value of items of sizes 1..len(value), each any number of times, within `room`, and how many of each."""
    n = len(value)
    best, pick = np.zeros(room + 1), np.zeros(room + 1, np.int64)
    for w in range(1, room + 1):
        x = best[w - min(n, w) : w][::-1] + value[: min(n, w)]  # item i + 1 leaves w - i - 1
        i = int(np.argmax(x))
        best[w], pick[w] = (x[i], i + 1) if x[i] > best[w - 1] else (best[w - 1], 0)
    count, w = np.zeros(n, np.int64), room
    while w:
        if pick[w]:
            count[pick[w] - 1] += 1
            w -= pick[w]
        else:
            w -= 1
    return float(best[room]), count


def cutting_stock(demand: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Patterns (pieces of each size 1..n, n the room of a sequence) and how often each is used; covers the demand."""
    room = len(demand)
    used = np.flatnonzero(demand > 0)
    if not len(used):
        return []
    m, sizes, need = len(used), used + 1, demand[used].astype(float)
    columns = [np.eye(m)[j] * (room // sizes[j]) for j in range(m)]
    cost = np.ones(m)
    inverse = np.diag([1.0 / (room // s) for s in sizes])
    x = inverse @ need
    for _ in range(60 * m + 200):
        y = cost @ inverse
        if y.min() < -1e-9:  # a covered class costs nothing more: its surplus enters
            j = int(np.argmin(y))
            new, price = -np.eye(m)[j], 0.0
        else:
            value = np.zeros(room)
            value[used] = np.maximum(y, 0)
            worth, count = knapsack(value, room)
            total = float(cost @ x)
            if worth <= 1 + 1e-9 or total - total / worth <= max(0.5, GAP * total):
                break
            new, price = count[used].astype(float), 1.0
        d = inverse @ new
        ok = d > 1e-9
        if not ok.any():
            break
        ratio = np.where(ok, x / np.where(ok, d, 1), np.inf)
        r = int(np.argmin(ratio))
        x = x - ratio[r] * d
        x[r] = ratio[r]
        x = np.maximum(x, 0)
        pivot = inverse[r] / d[r]
        inverse = inverse - np.outer(d, pivot)
        inverse[r] = pivot
        columns[r], cost[r] = new, price
    out, left = [], demand.astype(np.int64).copy()
    for column, price, n in sorted(zip(columns, cost, x, strict=True), key=lambda t: -t[2]):
        if price and (k := int(n + 1e-6)):
            p = np.zeros(room, np.int64)
            p[used] = np.rint(column).astype(np.int64)
            out.append((p, k))
            left -= p * k
    left = np.maximum(left, 0)
    bins: list[tuple[int, np.ndarray]] = []  # what rounding down has left: at most a few pieces per pattern, best fit
    for s in range(room, 0, -1):
        n = int(left[s - 1])
        while n and room // s > 1 and n >= room // s:  # whole sequences of one class first
            p = np.zeros(room, np.int64)
            p[s - 1] = room // s
            k = n // (room // s)
            out.append((p, k))
            n -= k * (room // s)
        if s > room // 2 and n > 64:  # pieces above half the room that found no pattern stand alone
            p = np.zeros(room, np.int64)
            p[s - 1] = 1
            out.append((p, n - 64))
            n = 64
        for _ in range(n):
            fits = [i for i, (free, _) in enumerate(bins) if free >= s]
            if fits:
                i = min(fits, key=lambda i: bins[i][0])
            else:
                bins.append((room, np.zeros(room, np.int64)))
                i = len(bins) - 1
            bins[i][1][s - 1] += 1
            bins[i] = (bins[i][0] - s, bins[i][1])
    return out + [(p, 1) for _, p in bins]


def places(patterns: list[tuple[np.ndarray, int]], room: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By class: first rank, first sequence and pieces a sequence of each pattern that holds the class."""
    base, out = 0, {c: ([0], [], []) for c in range(1, room + 1)}
    for p, k in patterns:
        for c in np.flatnonzero(p) + 1:
            first, seq, each = out[c]
            seq.append(base)
            each.append(p[c - 1])
            first.append(first[-1] + k * p[c - 1])
        base += k
    return {c: tuple(map(np.array, x)) for c, x in out.items() if x[1]}


def pack(docs: DataFrame, path: str, end_id: int = 1, length: int = 2048, key: str = "doc_id", text_col: str = "text", unit: int = UNIT) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each id of each document, its end id included, lies in exactly one piece. A null or empty text is the end id
    alone; a text of any length is cut into as many pieces as it needs. Rows that repeat an id are packed each on its
    own. Ties in rank are broken by id, start and checksum, so equal rows are interchangeable. Only the two named
    columns are read; an empty table gives no rows. A sequence holds at most `length` tokens.
    """
    room = -(-length // unit)
    if length % unit:
        raise ValueError("the sequence length must be a multiple of the unit")
    cut = written(pieces(docs, path, end_id, length, key, text_col).withColumn("class", F.expr(f"cast(ceil(length / {unit}) as int)")), "pieces")
    total = {r["class"]: r["n"] for r in cut.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}
    demand = np.array([total.get(c, 0) for c in range(1, room + 1)], np.int64)
    deal = places(cutting_stock(demand), room)
    # A class may hold any share of the rows: it is ranked in slots of bounded size, and slots follow one another.
    slots = int(max(64, demand.sum() // 200_000))
    cut = cut.withColumn("slot", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "start"), F.lit(slots)))
    ahead = Window.partitionBy("class").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    before = cut.groupBy("class", "slot").agg(F.count(F.lit(1)).alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    own = Window.partitionBy("class", "slot").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = cut.withColumn("own", F.row_number().over(own)).join(before, ["class", "slot"]).withColumn("rank", F.expr("ahead + own - 1"))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, rank = batch.column(5).to_numpy(), batch.column(6).to_numpy()
            seq, at = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
            for k in np.unique(c):
                first, base, each = deal[int(k)]
                mine = c == k
                j = np.searchsorted(first, rank[mine], side="right") - 1
                inner = rank[mine] - first[j]
                seq[mine], at[mine] = base[j] + inner // each[j], inner % each[j]
            yield pa.record_batch([*batch.columns[:5], flat(seq, pa.int64()), batch.column(5), flat(at, pa.int64())], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "class", "at"])

    keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    kind = cut.schema["doc_id"].dataType.simpleString()
    placed = ranked.select(*keep, "class", "rank").mapInArrow(dealt, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, class int, at long")
    order = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "at").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(*keep, "sequence_id", F.coalesce(F.sum("length").over(order), F.lit(0)).cast("long").alias("offset"))
