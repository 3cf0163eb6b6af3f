"""Class-based n-gram scoring: exchange clustering of words, class transitions and word emissions.

Training counts every word of every training text. All words seen more than once are clustered by exchange: a word
moves to the class under which its neighbours' classes are likeliest, if the exact gain of that one move is positive.
The LOOKUP most frequent words (a table of bounded size that travels with the tasks) start from classes by rank and
move in sweeps. In a sweep the words are dealt, by rank, to a fixed number of hands; each hand goes through its words
one by one, with its own copy of the classes and of the table of class bigrams, both of which follow its moves. Then
the table is counted anew, and a sweep that made the whole worse is taken back and tried with a part of the words.
Classes depend on neither partitions nor batches; of classes that are equally likely the first one wins. The other words seen more than once stay distributed: each joins the class under
which its neighbours' classes are likeliest. Words seen once and unseen ones are the tail class.

P(w | w') = P(class(w) | class(w')) * P(w | class(w)), with transitions smoothed towards class frequencies and the
tail's emissions by one for each of its words and one for all unseen ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.llm.common import buffers, crc_mod, dropped, flat, lists, steps, written
from lineweave.llm.hashindex import HashIndex
from lineweave.llm.words import words

#: Words whose classes and counts travel with the tasks, classes, sweeps at most.
LOOKUP, CLASSES, SWEEPS = 1 << 18, 64, 6
#: Share of words below which a sweep's moves are left and the classes are settled.
SETTLED = 0.001
#: Weight of the class frequencies in a transition, in tokens.
PRIOR = 5.0
#: Distinct words or bigrams that a counting task holds before it hands them on.
HELD = 1 << 19
#: The end of a text, as a word.
END = np.int64(0x454E44)
#: Class numbers: clusters, then the tail and the end.
TAIL, STOP, KINDS = CLASSES, CLASSES + 1, CLASSES + 2
#: Words whose neighbours' classes are counted together.
SLICE = 128
#: Added to counts of class bigrams when a word looks for a class.
SOFT = 0.1
#: Hands that the words of a sweep are dealt to.
DEALT = 128
#: Added to the number of a neighbour to the left.
LEFT = 1 << 24


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts with END after each, and the offset of each text's first token."""
    h, _, _, first = words(data, off)
    n = np.diff(first) + 1
    start = np.concatenate([[0], np.cumsum(n)])
    out = np.full(start[-1], END, np.int64)
    keep = np.ones(len(out), bool)
    keep[start[1:] - 1] = False
    out[keep] = h.view(np.int64)
    return out, start


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, n) over all texts, with the end of a text as a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Counter("word")
        for batch in batches:
            data, off = buffers(batch.column(0))
            for lo, hi in steps(off, 2 << 20):
                yield from held.add(tokens(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])[0])
        yield from held.flush()

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class _Counter:
    """Counts 64-bit keys and hands them on when it holds HELD of them."""

    def __init__(self, name: str):
        self.name, self.keys, self.counts, self.size = name, [], [], 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        k, n = np.unique(keys, return_counts=True)
        self.keys.append(k)
        self.counts.append(n)
        self.size += len(k)
        if self.size > 2 * HELD:
            self._merge()
            if self.size > HELD:
                yield from self.flush()

    def _merge(self) -> None:
        k, at = np.unique(np.concatenate(self.keys), return_inverse=True)
        self.keys, self.counts, self.size = [k], [np.bincount(at, np.concatenate(self.counts)).astype(np.int64)], len(k)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.keys:
            self._merge()
            k, n = self.keys[0], self.counts[0]
            for lo in range(0, len(k), 1 << 16):
                yield pa.record_batch([flat(k[lo : lo + (1 << 16)], pa.int64()), flat(n[lo : lo + (1 << 16)], pa.int64())], names=[self.name, "n"])
        self.keys, self.counts, self.size = [], [], 0


@dataclass(frozen=True)
class Vocabulary:
    """The LOOKUP most frequent words seen more than once, by falling count, then the end; N tokens, V distinct words."""

    word: np.ndarray
    count: np.ndarray
    n: int
    v: int
    more: bool  # whether there are other words seen more than once

    def first_kinds(self) -> np.ndarray:
        """The class by rank of each word, then that of a word that isn't here (position -1)."""
        kind = np.arange(len(self.word)) % CLASSES
        kind[self.word == END] = STOP
        return np.append(kind, TAIL).astype(np.int64)


def vocabulary(counts: DataFrame) -> Vocabulary:
    all_n, all_v, often = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("word"), F.count_if((F.col("n") > 1) & (F.col("word") != int(END)))).first()
    top = counts.where((F.col("n") > 1) & (F.col("word") != int(END))).orderBy(F.desc("n"), "word").limit(LOOKUP).toArrow()  # LOOKUP rows at most
    ends = counts.where(F.col("word") == int(END)).first()
    word, n = np.append(top["word"].to_numpy(), END), np.append(top["n"].to_numpy(), ends["n"] if ends else 0)
    return Vocabulary(word, n, int(all_n), int(all_v), int(often) > len(word) - 1)


def contexts(docs: DataFrame, text_col: str, vocab: Vocabulary) -> DataFrame:
    """(unit, own, right, right_n, left, left_n): how often each looked-up word stands beside itself and beside others.

    All words that aren't looked up are the unit after the last. Lists are bounded by the lookup's size. A text begins
    after an end.
    """
    shared, units = docs.sparkSession.sparkContext.broadcast(vocab.word), len(vocab.word) + 1
    stop = np.flatnonzero(vocab.word == END)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, held = HashIndex(shared.value.view(np.uint64)), _Counter("pair")
        for batch in batches:
            data, off = buffers(batch.column(0))
            for lo, hi in steps(off, 2 << 20):
                t, _ = tokens(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                u = index.find(t.view(np.uint64)).astype(np.int64)
                u[u < 0] = units - 1
                yield from held.add(np.concatenate([stop, u[:-1]]) * units + u)
        yield from held.flush()

    pairs = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    left, right = F.expr(f"cast(pair div {units} as int)"), F.expr(f"cast(pair % {units} as int)")
    sides = F.array(F.struct(left.alias("unit"), right.alias("at")), F.struct(right.alias("unit"), (left + LEFT).alias("at")))
    each = pairs.select(F.explode(sides).alias("e"), "n").select((F.col("e.unit") % DEALT).alias("hand"), (F.col("e.unit") % DEALT * units + F.col("e.unit")).cast("int").alias("turn"), "e.at", "n")
    dealt = each.repartition(DEALT, "hand").sortWithinPartitions("turn").select("turn", "at", "n")
    return dealt.mapInArrow(lambda batches: _gathered(batches, units), "unit int, own long, right binary, right_n binary, left binary, left_n binary")


def _gathered(batches: Iterator[pa.RecordBatch], units: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by turn (hand * units + unit) as one row per unit: neighbours as 32-bit, counts as 64-bit numbers."""

    def rows(turn: np.ndarray, at: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        start, unit = np.flatnonzero(np.diff(turn, prepend=-1)), turn % units
        for lo in range(0, len(start), 1024):
            out = []
            for a, b in zip(start[lo : lo + 1024], [*start[lo + 1 : lo + 1025], len(unit)], strict=False):
                x, k = at[a:b], n[a:b]
                to_left = x >= LEFT
                own = x == unit[a]
                r, l = ~to_left & ~own, to_left & (x != unit[a] + LEFT)
                out.append((int(unit[a]), int(k[own].sum()), x[r].tobytes(), k[r].tobytes(), (x[l] - LEFT).tobytes(), k[l].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), *[pa.binary()] * 4), strict=True)], names=["unit", "own", "right", "right_n", "left", "left_n"])

    held = [np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64)]
    for batch in batches:
        held = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True)]
        done = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last unit may go on
        if done:
            yield from rows(*(h[:done] for h in held))
            held = [h[done:] for h in held]
    yield from rows(*held)


def _entries(at: pa.Array, n: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, neighbour and count of all entries of rows of neighbours."""
    (data, off), (counts, _) = buffers(at), buffers(n)
    return np.repeat(np.arange(len(at)), np.diff(off) // 4), np.frombuffer(data.tobytes(), np.int32), np.frombuffer(counts.tobytes(), np.int64)


def _side(entries: tuple[np.ndarray, np.ndarray, np.ndarray], rows: int, kind: np.ndarray) -> np.ndarray:
    """Counts of (row, class of the neighbour)."""
    row, x, n = entries
    return np.bincount(row * KINDS + kind[x], n, minlength=rows * KINDS).reshape(rows, KINDS)


def _table(near: DataFrame, kind: np.ndarray) -> np.ndarray:
    """Counts of class bigrams; each task leaves KINDS * KINDS sums."""
    shared = near.sparkSession.sparkContext.broadcast(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((KINDS, KINDS))
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                part = batch.slice(lo, 1024)
                k = shared.value[part.column(0).to_numpy()]
                np.add.at(sums, k, _side(_entries(part.column(2), part.column(3)), len(part), shared.value))
                np.add.at(sums, (k, k), part.column(1).to_numpy())
        some = np.flatnonzero(sums)
        yield pa.record_batch([flat(some, pa.int64()), flat(sums.ravel()[some], pa.float64())], names=["at", "n"])

    got = near.select("unit", "own", "right", "right_n").mapInArrow(run, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros(KINDS * KINDS)
    sums[got["at"].to_numpy()] = got["n"].to_numpy()
    return sums.reshape(KINDS, KINDS)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(table: np.ndarray) -> float:
    """Of the class bigrams, but for terms that the classes don't change."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(1)).sum() - _xlogx(table.sum(0)).sum())


def _one(x: float) -> float:
    return x * math.log(x) if x > 0 else 0.0


class Exchange:
    """A table of class bigrams that follows the moves of single words; gain() is exact."""

    def __init__(self, table: np.ndarray):
        self.table, self.rows, self.columns = table.copy(), table.sum(1), table.sum(0)
        self.terms, self.logs = _xlogx(table), np.log(table + SOFT)
        self.log_sums = np.log([self.rows + SOFT * KINDS, self.columns + SOFT * KINDS])

    def choice(self, right: np.ndarray, left: np.ndarray) -> int:
        """As likeliest() for one word, from logarithms that follow the moves."""
        to, of = self.logs[:CLASSES] @ right - self.log_sums[0, :CLASSES] * right.sum(), left @ self.logs[:, :CLASSES] - self.log_sums[1, :CLASSES] * left.sum()
        return int(np.argmax(to + of))

    def likeliest(self, right: np.ndarray, left: np.ndarray) -> np.ndarray:
        """For many words at once, the class under which their neighbours' classes are likeliest."""
        t = self.table + SOFT
        return np.argmax(right @ np.log(t / t.sum(1, keepdims=True))[:CLASSES].T + left @ np.log(t / t.sum(0, keepdims=True))[:, :CLASSES], axis=1)

    def _tried(self, a: int, b: int, right: np.ndarray, left: np.ndarray, own: float) -> tuple[float, np.ndarray, np.ndarray, list[float]]:
        """Gain, rows a and b then columns a and b, their terms, and their sums, once a word has gone from class a to b."""
        t, x = self.table, self.terms
        new = np.stack([t[a] - right, t[b] + right, t[:, a] - left, t[:, b] + left])
        cells = ((new[0, a] - left[a] - own, new[0, b] + left[a]), (new[1, a] - left[b], new[1, b] + left[b] + own))
        for i in (0, 1):
            for j, y in ((0, a), (1, b)):
                new[i, y] = cells[i][j]
                new[2 + j, (a, b)[i]] = cells[i][j]
        terms, n, m = _xlogx(new), right.sum() + own, left.sum() + own
        sums = [self.rows[a] - n, self.rows[b] + n, self.columns[a] - m, self.columns[b] + m]
        old = (self.rows[a], self.rows[b], self.columns[a], self.columns[b])
        gain = terms.sum() - terms[0, a] - terms[0, b] - terms[1, a] - terms[1, b] - (x[a].sum() + x[b].sum() + x[:, a].sum() + x[:, b].sum() - x[a, a] - x[a, b] - x[b, a] - x[b, b])
        return float(gain) - sum(map(_one, sums)) + sum(map(_one, old)), new, terms, sums

    def gain(self, a: int, b: int, right: np.ndarray, left: np.ndarray, own: float) -> float:
        return self._tried(a, b, right, left, own)[0]

    def move(self, a: int, b: int, right: np.ndarray, left: np.ndarray, own: float, least: float = -math.inf) -> bool:
        """Move a word if it gains more than `least`; whether it has moved."""
        gain, new, terms, sums = self._tried(a, b, right, left, own)
        if gain <= least:
            return False
        for whole, part in ((self.table, new), (self.terms, terms), (self.logs, np.log(new + SOFT))):
            whole[a], whole[b], whole[:, a], whole[:, b] = part
        self.rows[a], self.rows[b], self.columns[a], self.columns[b] = sums
        la, lb, ca, cb = (math.log(x + SOFT * KINDS) for x in sums)
        self.log_sums[0, a], self.log_sums[0, b], self.log_sums[1, a], self.log_sums[1, b] = la, lb, ca, cb
        return True


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each hand in turn, SLICE at a time, however the batches fall."""
    held = None
    for batch in batches:
        whole = batch if held is None else pa.concat_batches([held, batch])
        if not len(whole):
            continue
        unit = whole.column(0).to_numpy().astype(np.int64)
        start = np.flatnonzero(np.diff((unit % DEALT << 32) + unit // DEALT // SLICE, prepend=-1))
        for lo, hi in zip(start, start[1:], strict=False):
            yield whole.slice(lo, hi - lo)
        held = whole.slice(start[-1])
    if held is not None:
        yield held


def _among(entries: tuple[np.ndarray, np.ndarray, np.ndarray], unit: np.ndarray, units: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows of a slice have each of its words as a neighbour, and how often: (first place, row, count)."""
    row, x, n = entries
    place = np.full(units, -1, np.int32)
    place[unit] = np.arange(len(unit))
    word = place[x]
    hit = np.flatnonzero(word >= 0)
    by = hit[np.argsort(word[hit], kind="stable")]
    return np.searchsorted(word[by], np.arange(len(unit) + 1)), row[by], n[by]


def _sweep(near: DataFrame, kind: np.ndarray, table: np.ndarray, parts: int, part: int) -> np.ndarray:
    """Classes after each word of the part has moved to where the likelihood gains most, where it gains."""
    shared = near.sparkSession.sparkContext.broadcast((kind, table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hand = -1
        for some in _slices(batches):
            unit, own = some.column(0).to_numpy(), some.column(1).to_numpy()
            if unit[0] % DEALT != hand:
                hand, kind, model = unit[0] % DEALT, shared.value[0].copy(), Exchange(shared.value[1])
            moved = move_words(model, kind, unit, own, some.column(2), some.column(3), some.column(4), some.column(5), (unit // DEALT) % parts == part)
            yield pa.record_batch([flat(moved, pa.int64()), flat(kind[moved], pa.int64())], names=["unit", "kind"])

    got = near.mapInArrow(run, "unit long, kind long").toArrow()  # LOOKUP rows at most
    out = kind.copy()
    out[got["unit"].to_numpy()] = got["kind"].to_numpy()
    return out


def move_words(model: Exchange, kind: np.ndarray, unit: np.ndarray, own: np.ndarray, right: pa.Array, right_n: pa.Array, left: pa.Array, left_n: pa.Array, turn: np.ndarray) -> np.ndarray:
    """Move the words of a slice whose turn it is, one by one, in model and kind; gives the units that have moved.

    Class and gain are those of that moment: the counts of a word's neighbours' classes follow the moves of those that
    lie in the slice.
    """
    entries = _entries(right, right_n), _entries(left, left_n)
    after, before = (_side(e, len(unit), kind) for e in entries)
    sides = [(counts, *_among(e, unit, len(kind))) for counts, e in zip((after, before), entries, strict=True)]
    moved = []
    for i in np.flatnonzero(turn & (kind[unit] < CLASSES)):
        a, b = int(kind[unit[i]]), model.choice(after[i], before[i])
        if a != b and model.move(a, b, after[i], before[i], own[i], 1e-9):
            kind[unit[i]] = b
            moved.append(unit[i])
            for counts, first, row, n in sides:
                rows, times = row[first[i] : first[i + 1]], n[first[i] : first[i + 1]]
                counts[rows, a] -= times  # a row names a neighbour once on a side
                counts[rows, b] += times
    return np.array(moved, np.int64)


def exchange(near: DataFrame, kind: np.ndarray, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """The class of each unit and the counts of class bigrams, after sweeps until no word gains."""
    table, parts = _table(near, kind), 1
    best = likelihood(table)
    for sweep in range(sweeps):
        moved = _sweep(near, kind, table, parts, sweep % parts)
        if parts == 1 and (moved != kind).sum() <= SETTLED * len(kind):
            break
        new = _table(near, moved)
        if (now := likelihood(new)) > best:
            kind, table, best = moved, new, now
        else:
            parts *= 4
    return kind, table


def rare_words(docs: DataFrame, text_col: str, vocab: Vocabulary, kind: np.ndarray, table: np.ndarray) -> DataFrame:
    """(word, n, kind, near): the words seen more than once that aren't looked up, each in the class of most gain.

    near lists the word's neighbours by class, left * KINDS + right, with counts: KINDS * KINDS at most. A neighbour
    that isn't looked up counts as tail.
    """
    shared = docs.sparkSession.sparkContext.broadcast((vocab.word, kind))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, kind = shared.value
        index = HashIndex(word.view(np.uint64))
        for batch in batches:
            data, off = buffers(batch.column(0))
            for lo, hi in steps(off, 2 << 20):
                t, _ = tokens(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                at = index.find(t.view(np.uint64))
                k = kind[at]
                here = np.flatnonzero(at < 0)  # never a text's end, so there is a next token
                yield pa.record_batch([flat(t[here], pa.int64()), flat((np.where(here > 0, k[here - 1], STOP) * KINDS + k[(here + 1) % len(k)]).astype(np.int32), pa.int32())], names=["word", "at"])

    each = docs.select(F.col(text_col).cast("string")).mapInArrow(seen, "word long, at int").groupBy("word", "at").agg(F.count(F.lit(1)).alias("n"))
    whole = each.groupBy("word").agg(F.sum("n").alias("n"), F.collect_list(F.struct("at", "n")).alias("near")).where("n > 1")

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Exchange(table)
        for batch in batches:
            for lo in range(0, len(batch), 4096):
                part = batch.slice(lo, 4096)
                row = np.repeat(np.arange(len(part)), part.column(2).value_lengths().to_numpy())
                items = part.column(2).flatten()
                left, right = np.divmod(items.field(0).to_numpy(), KINDS)
                n, size = items.field(1).to_numpy(), len(part) * KINDS
                x = [np.bincount(row * KINDS + k, n, minlength=size).reshape(len(part), KINDS) for k in (right, left)]
                yield pa.record_batch([part.column(0), part.column(1), flat(model.likeliest(*x).astype(np.int32), pa.int32()), part.column(2)], names=["word", "n", "kind", "near"])

    return whole.mapInArrow(chosen, "word long, n long, kind int, near array<struct<at:int,n:long>>")


def _rare_table(rare: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """What the rare words add to the class bigrams (and take from the tail's), and the tokens they add to classes."""
    each = rare.select("kind", F.inline("near")).select("kind", "n", F.expr(f"at div {KINDS}").alias("left"), F.expr(f"at % {KINDS}").alias("right"))
    change = np.zeros((KINDS, KINDS))
    for side in ("left", "right"):
        for k, other, n in each.where(F.col(side) != TAIL).groupBy("kind", side).agg(F.sum("n")).collect():  # KINDS * KINDS rows
            for cell, sign in ((k, 1), (TAIL, -1)):
                change[(other, cell) if side == "left" else (cell, other)] += sign * n
    tokens_of = np.zeros(KINDS)
    for k, n in rare.groupBy("kind").agg(F.sum("n")).collect():
        tokens_of[k] = n
    return change, tokens_of


@dataclass(frozen=True)
class Model:
    """All logarithms to base 10: transition between classes, emission of each looked-up word (0 for others).

    size: training tokens of each class; tail_v: distinct words of the tail class.
    """

    vocab: Vocabulary
    kind: np.ndarray
    transition: np.ndarray
    emission: np.ndarray
    size: np.ndarray
    tail_v: int


def fit(docs: DataFrame, text_col: str, counts: DataFrame) -> tuple[Model, DataFrame | None]:
    """The model, and the words (word, kind) that have a class but aren't looked up, if there are any; written."""
    vocab = vocabulary(counts)
    near = written(contexts(docs, text_col, vocab), "contexts")
    kind, table = exchange(near, vocab.first_kinds())
    dropped(docs.sparkSession, near)
    size, rare, n_rare = np.bincount(kind[:-1], vocab.count, minlength=KINDS), None, 0
    if vocab.more:
        full = written(rare_words(docs, text_col, vocab, kind, table), "rare-words")
        change, more = _rare_table(full)
        table, size, n_rare = np.maximum(table + change, 0), size + more, full.count()
        rare = full.select("word", "kind")
    tail_v = vocab.v - int((vocab.count > 0).sum()) - n_rare
    size[TAIL] = vocab.n - size.sum()
    share = (table.sum(0) + 1) / (table.sum() + KINDS)
    transition = np.log10((table + PRIOR * share) / (table.sum(1, keepdims=True) + PRIOR))
    emission = np.append(np.log10(np.maximum(vocab.count, 1) / np.maximum(size[kind[:-1]], 1)), 0.0)
    return Model(vocab, kind, transition, emission, size, tail_v), rare


def score(docs: DataFrame, model: Model, rare: DataFrame | None, counts: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, n_known, base_score, score, as score_held_out() says."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    v = model.vocab
    base_of = np.log10((np.append(v.count, 0) + 1) / (v.n + v.v + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        index = HashIndex(m.vocab.word.view(np.uint64))
        for batch in batches:
            data, off = buffers(batch.column(1))
            for lo, hi in steps(off, 2 << 20):
                t, start = tokens(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                at = index.find(t.view(np.uint64))
                kind = np.where(at < 0, -1, m.kind[at])
                before = np.concatenate([[STOP], kind[:-1]])
                before[start[:-1]] = STOP
                after = np.append(kind[1:], STOP)  # of a word; a text's last token is its end
                tail = at < 0
                known = ~tail & (before >= 0)
                part = np.where(known, m.transition[before, kind], 0.0) + m.emission[at]
                base = np.where(tail, 0.0, base_of[at])
                sums = [np.add.reduceat(x, start[:-1]) for x in (part, base, (~tail & (m.vocab.count[at] > 0)).astype(np.int64))]
                # each word that isn't looked up with the classes beside it; -1: such a word too, the one before is named
                last = np.concatenate([[0], t[:-1]])
                n = np.add.reduceat(tail.astype(np.int64), start[:-1])
                named = [lists(x[tail], n, kind_) for x, kind_ in ((t, pa.int64()), (before.astype(np.int16), pa.int16()), (after.astype(np.int16), pa.int16()), (last, pa.int64()))]
                yield pa.record_batch(
                    [batch.column(0).slice(lo, hi - lo), flat(np.diff(start), pa.int64()), flat(sums[2], pa.int64()), flat(sums[1], pa.float64()), flat(sums[0], pa.float64()), *named],
                    names=["doc_id", "n_tokens", "n_seen", "base", "part", "word", "before", "after", "last"],
                )

    name = f"doc_id {docs.schema[key].dataType.simpleString()}, n_tokens long, n_seen long, base double, part double, word array<long>, before array<short>, after array<short>, last array<long>"
    rows = docs.select(F.col(key), F.col(text_col).cast("string")).mapInArrow(run, name).withColumn("row", F.monotonically_increasing_id())
    rows = written(rows, "scores")
    each = rows.select("row", F.inline(F.arrays_zip("word", "before", "after", "last")))
    kinds = counts if rare is None else counts.join(rare, "word", "left")
    kinds = kinds.select("word", "n", F.lit(TAIL).alias("kind") if rare is None else F.coalesce("kind", F.lit(TAIL)).alias("kind"))
    each = each.join(kinds, "word", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("kind", F.coalesce("kind", F.lit(TAIL)))
    if rare is not None:
        follows = each.where("before < 0").join(rare.select(F.col("word").alias("last"), F.col("kind").alias("k")), "last", "left")
        each = each.where("before >= 0").unionByName(follows.withColumn("before", F.coalesce("k", F.lit(TAIL)).cast("short")).drop("k"))
    else:
        each = each.withColumn("before", F.when(F.col("before") < 0, TAIL).otherwise(F.col("before")).cast("short"))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            row, n, kind, before, after = (batch.column(k).to_numpy() for k in range(5))
            tail = kind == TAIL
            emission = np.log10(np.where(tail, (n + 1) / (m.size[TAIL] + m.tail_v + 1), n / np.maximum(m.size[kind], 1)))
            # the step to a word that is looked up; one that isn't counts the step from this one itself
            part = m.transition[before, kind] + emission + np.where(after >= 0, m.transition[kind, after], 0.0)
            yield pa.record_batch([flat(row, pa.int64()), flat((n > 0).astype(np.int64), pa.int64()), flat(np.log10((n + 1) / (m.vocab.n + m.vocab.v + 1)), pa.float64()), flat(part, pa.float64())], names=["row", "known", "base", "part"])

    sums = each.select("row", "n", "kind", "before", "after").mapInArrow(added, "row long, known long, base double, part double")
    sums = sums.groupBy("row").agg(F.sum("known").alias("n_tail"), F.sum("base").alias("base_tail"), F.sum("part").alias("part_tail"))
    zero = F.lit(0.0)
    return rows.select("row", "doc_id", "n_tokens", "n_seen", "base", "part").join(sums, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_seen") + F.coalesce("n_tail", F.lit(0))).alias("n_known"),
        F.lit(v.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_tail", zero)).alias("base_score"),
        (F.col("part") + F.coalesce("part_tail", zero)).alias("score"),
    )


def score_held_out(docs: DataFrame, folds: int = 7, held_out: int = 2) -> DataFrame:
    """Learn from documents whose crc32(doc_id) modulo `folds` isn't `held_out`; score all whole texts.

    One row per row of docs: doc_id, held_out, n_tokens (words and one end), n_known (tokens seen in training),
    train_tokens, base_score (add-one unigram log10 probability), score (the class model's log10 probability). A null
    or empty text is its end alone. A null id is not learned from and not held out. Rows that repeat an id count and
    are scored each. Without training texts all words are unseen. Only doc_id and text are read.
    """
    learn = docs.where(crc_mod("doc_id", folds) != held_out)
    counts = written(word_counts(learn, "text"), "word-counts")
    out = score(docs, *fit(learn, "text", counts), counts)
    return out.withColumn("held_out", F.coalesce(crc_mod("doc_id", folds) == held_out, F.lit(False)))
