"""Byte-level BPE encoding and decoding on padded numpy matrices.

A text is cut by the vocabulary's pattern. The distinct pieces that aren't known yet are dealt into buckets by length
and padded to matrices of ids; in each round every row merges its leftmost pair of least rank, and rows without a pair
leave the matrix. Pairs are looked up in a hash table that holds, for each token, all its cuts into two tokens. A
piece above LONGEST bytes, for which rounds would take quadratic time, merges the same pairs in the same order with a
heap instead.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.llm.common import buffers, steps
from lineweave.llm.hashindex import HashIndex

LONGEST = 256
#: Pieces whose ids a worker keeps at most.
KEPT = 150_000
_NONE = np.int32(0x7FFFFFFF)


class Bpe:
    """A vocabulary of byte strings by rank, and the pattern that cuts texts."""

    _loaded: dict[tuple[str, str], Bpe] = {}

    @classmethod
    def load(cls, path: str, pattern: str) -> Bpe:
        """From a file of base64 tokens and ranks; kept for the worker's life."""
        if (path, pattern) not in cls._loaded:
            with open(path, "rb") as f:
                cls._loaded[path, pattern] = cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, pattern)
        return cls._loaded[path, pattern]

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        # \s stands for Unicode's white space, to which this library's \s adds four control characters
        self.pattern = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.ranks = ranks
        self.byte_id = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        tokens = sorted(ranks, key=ranks.__getitem__)
        size = max(ranks.values()) + 1
        self.length = np.zeros(size, np.int64)
        self.length[[ranks[t] for t in tokens]] = [len(t) for t in tokens]
        self.start = np.zeros(size, np.int64)
        self.start[[ranks[t] for t in tokens]] = np.cumsum([0, *(len(t) for t in tokens)])[:-1]
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        pairs = {}
        for t in tokens:
            for k in range(1, len(t)):
                if (a := ranks.get(t[:k])) is not None and (b := ranks.get(t[k:])) is not None:
                    pairs[a << 24 | b] = ranks[t]
        self.index = HashIndex(np.fromiter(pairs, np.uint64, len(pairs)))
        self.merged = np.append(np.fromiter(pairs.values(), np.int32, len(pairs)), _NONE)
        self.pairs = pairs
        self.known: dict[str, bytes] = {}

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id that each pair merges into; _NONE for pairs that don't merge or hold padding (-1)."""
        key = (np.maximum(a, 0).astype(np.uint64) << np.uint64(24)) | np.maximum(b, 0).astype(np.uint64)
        return np.where((a >= 0) & (b >= 0), self.merged[self.index.find(key.ravel())].reshape(a.shape), _NONE)

    def _rounds(self, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids: rows padded with -1, size: ids in each. Merges until no row has a pair."""
        done, rows, live = np.full_like(ids, -1), np.arange(len(ids)), ids.copy()
        rank = self._rank(live[:, :-1], live[:, 1:])
        at = np.arange(live.shape[1])
        while len(rows):
            m = np.argmin(rank, axis=1)
            best = rank[np.arange(len(rows)), m]
            go = best != _NONE
            if not go.all():
                done[rows[~go]] = live[~go]
                rows, live, rank, m, best = rows[go], live[go], rank[go], m[go], best[go]
                if not len(rows):
                    break
            own = np.arange(len(rows))
            source = np.minimum(at + (at > m[:, None]), live.shape[1] - 1)
            live = np.take_along_axis(live, source, axis=1)
            live[own, m] = best
            size[rows] -= 1
            live[own, size[rows]] = -1
            rank = np.take_along_axis(rank, np.minimum(source[:, :-1], rank.shape[1] - 1), axis=1)
            rank[own, np.minimum(size[rows], rank.shape[1] - 1)] = _NONE
            right = np.where(m + 1 < live.shape[1], live[own, np.minimum(m + 1, live.shape[1] - 1)], -1)
            inner = m < rank.shape[1]
            rank[own[inner], m[inner]] = self._rank(live[own, m], right)[inner]
            left = m > 0
            rank[own[left], m[left] - 1] = self._rank(live[own[left], m[left] - 1], live[own[left], m[left]])
        return done, size

    def _long(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece, by a heap of (rank, position)."""
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        n, pairs = len(ids), self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pairs.get(ids[i] << 24 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (x := pairs.get(r << 24 | ids[k])) is not None:
                    heapq.heappush(heap, (x, i, r, ids[k]))
            if (p := before[i]) >= 0 and (x := pairs.get(ids[p] << 24 | r)) is not None:
                heapq.heappush(heap, (x, p, ids[p], r))
        out = np.array(ids, np.int32)
        return out[out >= 0]

    def pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece."""
        out: list = [None] * len(pieces)
        size = np.array([len(p) for p in pieces], np.int64)
        for k in np.flatnonzero(size > LONGEST):
            out[k] = self._long(pieces[k])
        lo = 0
        for hi in (1, 2, 4, 6, 8, 12, 16, 24, 32, 64, 128, LONGEST):
            chosen = np.flatnonzero((size > lo) & (size <= hi))
            lo = hi
            for part in (chosen[i : i + (1 << 18) // hi] for i in range(0, len(chosen), (1 << 18) // hi)):
                n = size[part]
                ids = np.full((len(part), hi), -1, np.int32)
                ids[np.arange(hi) < n[:, None]] = self.byte_id[np.frombuffer(b"".join([pieces[k] for k in part]), np.uint8)]
                if hi > 1:
                    ids, n = self._rounds(ids, n.copy())
                for k, row, m in zip(part.tolist(), ids, n.tolist(), strict=True):
                    out[k] = row[:m]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        cut = [self.pattern.findall(t) for t in texts]
        new = list(set().union(*cut).difference(self.known))
        if len(self.known) + len(new) > KEPT:
            self.known.clear()
            new = list(set().union(*cut))
        for piece, ids in zip(new, self.pieces([p.encode() for p in new]), strict=True):
            self.known[piece] = ids.astype("<u4").tobytes()
        get = self.known.__getitem__
        return [b"".join(map(get, c)) for c in cut]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids in a row, and the end of each id's bytes."""
        n = self.length[ids]
        end = np.cumsum(n)
        total = int(end[-1]) if len(end) else 0
        return self.bytes[np.arange(total) + np.repeat(self.start[ids] - (end - n), n)], end


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the key and ids (binary, little-endian unsigned 32-bit, without special tokens).

    A null text counts as empty and has no ids. Only the two named columns are read; repeated rows each get a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.load(path, pattern)
        for batch in batches:
            data, off = buffers(batch.column(1))
            for lo, hi in steps(off):
                raw = data[off[lo] : off[hi]].tobytes()
                at = (off[lo : hi + 1] - off[lo]).tolist()
                ids = bpe.encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:], strict=False)])
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col(key), F.col(text_col).cast("string")).mapInArrow(run, f"doc_id {docs.schema[key].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str, key: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of encoded: the key, ids and text_bytes, the bytes that the ids stand for; null ids are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.load(path, pattern)
        for batch in batches:
            data, off = buffers(batch.column(1))
            for lo, hi in steps(off):
                ids = np.frombuffer(data[off[lo] : off[hi]].tobytes(), "<u4")
                out, end = bpe.decode(ids)
                at = np.concatenate([[0], end])[(off[lo : hi + 1] - off[lo]) // 4]
                raw = out.tobytes()
                texts = [raw[a:b] for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(texts, pa.binary())], names=["doc_id", "ids", "text_bytes"])

    return encoded.select(key, ids_col).mapInArrow(run, f"doc_id {encoded.schema[key].dataType.simpleString()}, ids binary, text_bytes binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode, decode, and per document n_tokens, ids_sha256 and decoded_sha256."""
    out = decode(encode(docs, path, pattern), path, pattern)
    return out.select(
        "doc_id", F.expr("cast(length(coalesce(ids, X'')) div 4 as long)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text_bytes", 256).alias("decoded_sha256")
    )
