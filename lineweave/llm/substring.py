"""Substring dedup with compact windows.

A text is a sequence of `width`-word shingles. For each of HASHES hash functions, a Cartesian tree over the shingles'
values gives compact windows (l, c, r): every passage that begins in l..c and ends in c..r has its least value at c.
Windows of fewer than `least` shingles hold no passage of interest and are not built. Two passages can only be alike
if they share least values, that is, if windows with equal values meet. Interval joins let them meet without all
pairs of a value:

1. Each window meets the first one of its value; pairs of texts whose aligned windows leave room for a passage under
   enough hash functions are verified on their full texts. Two windows that have a value of the first function to
   themselves need no other.
2. Windows that no verified passage explains, as their value's first one was an unlike text (one with parts of the
   passage, an edited one, or one that only shares a frequent line), meet the first window of their value, and the
   first such unexplained one, with which they share the next DEPTHS shingles to the left or right. Texts that hold a
   passage in common go on alike beyond what they share with others, however many those are. Under the first function
   each passage of `least` shingles around the window's centre counts, too, by a hash of all its shingles: an exact
   repeat lies in one window of either text, so it is met whatever else shares the value.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.llm.common import buffers, collected, dropped, flat, mix, steps, whole_ids, written
from lineweave.llm.words import shingles, words

#: Hash functions; how many of them have to agree on a pair and alignment.
HASHES, AGREE = 4, 2
#: Shingles to either side that windows have to share to meet a second time; passages split by one word hold the least.
DEPTHS = (22, 33, 44)
#: Equal shingles in a row from which on they count as a run.
SHORTEST = 3
#: Shingles of a text whose trees are built together; longer texts come in overlapping parts.
PART = 1 << 22
_ODD = [np.uint64((0x9E3779B97F4A7C15 * (2 * i + 3) ^ 0x5851F42D4C957F2D) & 0xFFFFFFFFFFFFFFFF | 1) for i in range(16)]
_PLACES = np.uint64(0xFFFFFF)
_SPREAD, _GATHER = 0x9E3779, pow(0x9E3779, -1, 1 << 24)


def compact_windows(value: np.ndarray, off: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of all windows of at least `least` places; off: where texts begin.

    All trees grow together, a level at a time: the least value of each open interval splits it in two. Equal values
    are ordered by a scrambled place, so that the trees of texts that repeat themselves stay low.
    """
    n = len(value)
    if n >= 1 << 24:
        raise ValueError("too many places at once")
    # the low bits tell places apart, so that a minimum also says where it is
    key = (value & ~_PLACES) | (np.arange(n, dtype=np.uint64) * np.uint64(_SPREAD) & _PLACES)
    lo, hi = off[:-1], off[1:]
    begin = lo  # where an interval's values begin in key, which holds open intervals only
    out = []
    while True:
        size = hi - lo
        open_ = size >= least
        if not open_.all():
            lo, hi, begin, size = lo[open_], hi[open_], begin[open_], size[open_]
        if not len(lo):
            break
        start = np.cumsum(size) - size
        if start[-1] + size[-1] < 0.7 * len(key):
            key = key[np.arange(start[-1] + size[-1]) + np.repeat(begin - start, size)]
            begin = start
        if len(key) == start[-1] + size[-1]:
            least_key = np.minimum.reduceat(key, begin)
        else:
            cuts = np.stack([begin, begin + size], 1).ravel()
            least_key = np.minimum.reduceat(key, cuts[:-1] if cuts[-1] == len(key) else cuts)[::2]
        c = ((least_key & _PLACES) * np.uint64(_GATHER) & _PLACES).astype(np.int64)
        out.append((lo, c, hi - 1))
        after = begin + (c + 1 - lo)
        lo, hi, begin = np.stack([lo, c + 1], 1).ravel(), np.stack([c, hi], 1).ravel(), np.stack([begin, after], 1).ravel()
    if not out:
        return tuple(np.zeros((3, 0), np.int64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


#: A window in one number: 40 bits of c, 4 of the hash function, 10 each of the places beside c to the left and right,
#: as far as passages need them.
_C, _F, _L, _R = 24, 20, 10, 0
FAR = 1023


def _texts(batches: Iterator[pa.RecordBatch], width: int, least: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, shingles, offsets of texts, place of each text's first shingle) for texts worth a look, in bounded steps.

    A text of more than PART shingles comes in parts that overlap by twice what windows reach; so each centre is far
    enough from the ends of some part.
    """
    for batch in batches:
        data, off = buffers(batch.column(1))
        for lo, hi in steps(off, 2 << 20):
            h, _, _, first = words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            s, at = shingles(h, first, width)
            ids = batch.column(0).slice(lo, hi - lo)
            if len(s) <= PART:
                if len(s) >= least:
                    yield ids, s, at, np.zeros(hi - lo, np.int64)
                continue
            for i in range(hi - lo):  # steps of more than PART shingles hold one long text, or one and few others
                own = s[at[i] : at[i + 1]]
                for x in range(0, max(len(own) - 2 * FAR, 1), PART - 2 * FAR):
                    part = own[x : x + PART]
                    yield ids.slice(i, 1), part, np.array([0, len(part)]), np.array([x])


def _read(docs: DataFrame, key: str, text_col: str) -> DataFrame:
    return docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def windows(docs: DataFrame, key: str, text_col: str, width: int, least: int, hashes: int) -> DataFrame:
    """(value, id, place): each text's windows; value is the least hash value, place packs the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, s, at, base in _texts(batches, width, least):
            for f in range(hashes):
                v = s * _ODD[f]
                l, c, r = compact_windows(v, at, least)
                row = np.searchsorted(at, c, side="right") - 1
                place = (c - at[row] + base[row]).astype(np.uint64) << np.uint64(_C) | np.uint64(f << _F)
                place |= np.minimum(c - l, FAR).astype(np.uint64) << np.uint64(_L) | np.minimum(r - c, FAR).astype(np.uint64) << np.uint64(_R)
                yield pa.record_batch([flat(v[c].view(np.int64), pa.int64()), ids.take(flat(row, pa.int64())), flat(place.view(np.int64), pa.int64())], names=["value", "id", "place"])

    return _read(docs, key, text_col).mapInArrow(run, "value long, id long, place long")


def _part(column: str, low: int, bits: int) -> str:
    return f"cast(shiftrightunsigned({column}, {low}) & {(1 << bits) - 1} as int)"


def _candidates(w: DataFrame, least: int, agree: int) -> tuple[DataFrame, DataFrame]:
    """(id, mate, shifts): texts to compare with an earlier one, and by how many places passages are shifted; then
    the windows (value, id, place, lead) of values that more than two windows share."""
    # written, so that both sides of the join are freshly exchanged and a value of very many windows can be split
    ends = written(w.groupBy("value").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo != hi").select("value"), "values")
    shared = written(w.join(ends.hint("merge"), "value", "left_semi"), "windows")
    lead = shared.groupBy("value").agg(F.min(F.struct("id", "place")).alias("lead"), F.count(F.lit(1)).alias("n"))
    lead = written(lead.select("value", F.col("lead.id").alias("mate"), F.col("lead.place").alias("at"), "n"), "leads")
    left, right = (f"least({_part('place', k, 10)}, {_part('at', k, 10)})" for k in (_L, _R))
    met = shared.join(lead, "value").where(f"id != mate and {left} + {right} + 1 >= {least}")
    by_shift = met.groupBy("id", "mate", F.expr(f"shiftrightunsigned(at, {_C}) - shiftrightunsigned(place, {_C})").alias("shift")).agg(
        F.bit_or(F.expr(f"shiftleft(1, {_part('place', _F, 4)})")).alias("fs"), F.max(F.expr(f"n = 2 and {_part('place', _F, 4)} = 0")).alias("alone")
    )
    pair = by_shift.groupBy("id", "mate").agg(F.bit_or("fs").alias("fs"), F.max("alone").alias("alone"), F.collect_set("shift").alias("shifts"))
    pairs = written(pair.where((F.bit_count("fs") >= agree) | F.col("alone")).select("id", "mate", "shifts"), "candidates")
    # in a value of two windows both have met
    crowded = written(shared.join(lead.where("n > 2").select("value", F.col("mate").alias("lead")).hint("merge"), "value"), "crowded")
    dropped(w.sparkSession, ends, lead, shared)
    return pairs, crowded


def _second(docs: DataFrame, crowded: DataFrame, found: DataFrame, pairs: DataFrame, width: int, least: int) -> DataFrame:
    """(id, mate, shifts, exact): texts whose windows no passage explains, with the first text that goes on alike beside
    them, and by how many places what they share is shifted; exact: that of passages of `least` equal shingles."""
    spark = docs.sparkSession
    spans = found.groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("start_word", "end_word")).alias("spans"))
    c = f"shiftrightunsigned(place, {_C})"
    inside = F.expr(f"exists(spans, s -> s.start_word <= {c} and {c} + {width} <= s.end_word)")
    flagged = written(crowded.join(spans.hint("merge"), "id", "left").select("value", "id", "place", (~F.coalesce(inside, F.lit(False)) & F.expr("id != lead")).alias("open")), "flagged")
    values = written(flagged.where("open").select("value").distinct(), "open-values")
    own = flagged.join(values.hint("merge"), "value", "left_semi").groupBy("id").agg(F.collect_list(F.struct("value", "place", "open")).alias("own"))
    rows = docs.join(own.hint("merge"), "id").select("id", "text", F.col("own.value").alias("value"), F.col("own.place").alias("place"), F.col("own.open").alias("open"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffers(batch.column(1))
            for lo, hi in steps(off, 2 << 20):
                h, _, _, first = words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                s, at = shingles(h, first, width)
                part = batch.slice(lo, hi - lo)
                row = np.repeat(np.arange(hi - lo), part.column(2).value_lengths().to_numpy())
                value, place = (part.column(k).flatten().to_numpy().view(np.uint64) for k in (2, 3))
                open_ = part.column(4).flatten().to_numpy(zero_copy_only=False)
                local = (place >> np.uint64(_C)).astype(np.int64)
                near = np.flatnonzero(local < np.diff(at)[row])  # others are of another text of that id, as are those of another value
                f = (place[near] >> np.uint64(_F) & np.uint64(15)).astype(np.int64)
                here = near[s[at[row[near]] + local[near]] * np.array(_ODD)[f] == value[near]]
                reach = [(place[here] >> np.uint64(k) & np.uint64(FAR)).astype(np.int64) for k in (_L, _R)]
                whole = np.flatnonzero(f[np.searchsorted(near, here)] == 0)
                row, local, value, open_ = row[here], local[here], value[here], open_[here]
                centre, sums = at[row] + local, _Sums(s)

                def told(which: np.ndarray, begin: np.ndarray, n: int, salt: int, exact: bool) -> pa.RecordBatch:
                    key = mix(sums.of(begin, n) ^ value[which] ^ np.uint64(salt << 20))
                    place = begin - at[row[which]] if exact else local[which]
                    return pa.record_batch([flat(key.view(np.int64), pa.int64()), part.column(0).take(flat(row[which], pa.int64())), flat(place, pa.int64()), flat(open_[which], pa.bool_()), pa.array(np.full(len(which), exact))], names=["key", "id", "at", "open", "exact"])

                for t in DEPTHS:
                    left, right = np.flatnonzero(local >= t), np.flatnonzero(centre + t < at[row + 1])
                    yield told(left, centre[left] - t, t + 1, 2 * t, False)
                    yield told(right, centre[right], t + 1, 2 * t + 1, False)
                begin = centre[whole] - np.minimum(reach[0][whole], least - 1)
                n = np.maximum(np.minimum(centre[whole], centre[whole] + reach[1][whole] - least + 1) - begin + 1, 0)
                yield told(np.repeat(whole, n), np.arange(n.sum()) + np.repeat(begin - np.cumsum(n) + n, n), least, 0, True)

    keys = written(rows.mapInArrow(run, "key long, id long, at long, open boolean, exact boolean"), "keys")
    here = F.struct(F.col("id").alias("mate"), F.col("at").alias("there"))
    lead = keys.groupBy("key").agg(F.min(here).alias("first"), F.min(F.when(F.col("open"), here)).alias("unlike"), F.max(F.when(F.col("open"), F.col("id"))).alias("last")).where("last > first.mate")
    met = keys.where("open").join(lead.select("key", F.array_distinct(F.array("first", "unlike")).alias("leads")).hint("merge"), "key").select("id", "at", "exact", F.inline("leads"))
    shift = F.expr("there - at")
    met = met.where("mate < id").groupBy("id", "mate").agg(F.collect_set(F.when(~F.col("exact"), shift)).alias("shifts"), F.collect_set(F.when(F.col("exact"), shift)).alias("exact"))
    known = F.coalesce("known", F.array().cast("array<long>"))
    more = met.join(pairs.withColumnRenamed("shifts", "known"), ["id", "mate"], "left").select("id", "mate", *[F.array_except(c, known).alias(c) for c in ("shifts", "exact")])
    out = written(more.where("size(shifts) + size(exact) > 0"), "second")
    dropped(spark, flagged, values, keys)
    return out


class _Sums:
    """Hashes of any values in a row: a polynomial of them modulo 2**64."""

    def __init__(self, s: np.ndarray):
        base = 0x9E3779B97F4A7C15
        self.back = np.cumprod(np.full(len(s) + 1, np.uint64(pow(base, -1, 1 << 64))))
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(s * np.cumprod(np.full(len(s), np.uint64(base))))])

    def of(self, begin: np.ndarray, n: int) -> np.ndarray:
        return (self.total[begin + n] - self.total[begin]) * self.back[begin]


def _runs(a: np.ndarray, b: np.ndarray, d: int, shortest: int) -> np.ndarray:
    """[begin, end) of the runs of at least `shortest` shingles of a that b repeats d places further on."""
    lo, hi = max(0, -d), min(len(a), len(b) - d)
    if hi <= lo:
        return np.zeros((0, 2), np.int64)
    same = np.zeros(hi - lo + 2, np.int8)
    same[1:-1] = a[lo:hi] == b[lo + d : hi + d]
    edge = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2) + lo
    return edge[edge[:, 1] - edge[:, 0] >= shortest]


def _enough(a: np.ndarray, b: np.ndarray, shifts: list[int], exact: list[int], least: int) -> list[int]:
    """shifts, and those of `exact` that it takes for every passage of `least` shingles to lie in a run of some shift.

    Texts that repeat themselves meet along very many shifts, of which a few tell all.
    """
    shifts, exact = set(shifts), set(exact)
    covered = np.zeros(len(a), bool)  # by where passages begin

    def cover(edge: np.ndarray) -> None:
        for x, y in edge.tolist():
            covered[x : y - least + 1] = True

    for d in shifts:
        cover(_runs(a, b, d, least))
    more = [(x, -y, d) for d in exact - shifts for x, y in _runs(a, b, d, least).tolist()]
    for x, y, d in sorted(more, key=lambda m: (m[1] + m[0], m)):  # longest first
        if not covered[x : -y - least + 1].all():
            shifts.add(d)
            cover(_runs(a, b, d, least))
    return sorted(shifts)


def _alike(a: np.ndarray, b: np.ndarray, shifts: list[int], least: int, percent: int) -> list[tuple[int, int, int, int, float]]:
    """Passages [begin, end) of shingles of a that b repeats, with theirs of b and the Jaccard similarity.

    Along each shift, and the few next to it that a word more or less leads to, places with equal shingles make runs.
    Runs of fewer than SHORTEST shingles, and runs inside others, are passed over. Runs join while the joined
    passages can stay similar enough; what reaches `least` shingles is then measured on its shingle sets. Longer
    passages come first, and a passage inside an earlier one isn't told again.
    """
    runs = []
    for d in sorted({d + k for d in shifts for k in range(-2, 3)}):
        edge = _runs(a, b, d, SHORTEST)
        if len(edge):
            runs.append(np.column_stack([edge, np.full(len(edge), d)]))
    if not runs:
        return []
    runs = np.concatenate(runs)
    runs = runs[np.lexsort((runs[:, 2], -runs[:, 1], runs[:, 0]))]
    reach = np.maximum.accumulate(np.concatenate([[-1], runs[:-1, 1]]))
    runs = runs[runs[:, 1] > reach].tolist()  # what lies inside an earlier run tells nothing new of a
    found = []

    def measure(begin: int, end: int, d: int, e: int) -> bool:
        if end - begin < least or end + e - begin - d < least:
            return False
        p, q = np.unique(a[begin:end]), np.unique(b[begin + d : end + e])
        shared = len(np.intersect1d(p, q, assume_unique=True))
        similar = shared / (len(p) + len(q) - shared)
        if 100 * similar >= percent:
            found.append((begin, end, begin + d, end + e, float(similar)))
        return 100 * similar >= percent

    used = [False] * len(runs)
    for i in range(len(runs)):
        if used[i]:
            continue
        begin, end, d = runs[i]
        e, equal, members = d, end - begin, [i]
        for j in range(i + 1, len(runs)):
            x, y, f = runs[j]
            x = max(x, end, end + e - f)  # what the passage holds already doesn't count again, on either side
            if x >= y:
                continue
            more = equal + y - x
            # sets that share m of at most n and k members have a similarity of m / (n + k - m) at least
            if 100 * more < percent * ((y - begin) + (y + f - begin - d) - more):
                if x - end > least:
                    break
                continue
            end, e, equal = y, f, more
            members.append(j)
        if measure(begin, end, d, e):
            for j in members:
                used[j] = True
        else:
            for j in members:
                measure(runs[j][0], runs[j][1], runs[j][2], runs[j][2])
    out: list[tuple[int, int, int, int, float]] = []
    for p in sorted(set(found), key=lambda p: (p[0] - p[1], p)):
        if not any(q[0] <= p[0] and p[1] <= q[1] for q in out):
            out.append(p)
    return sorted(out)


def repeats(docs: DataFrame, key: str = "doc_id", text_col: str = "text", width: int = 5, least_words: int = 50, percent: int = 80, hashes: int = HASHES, agree: int = AGREE) -> DataFrame:
    """Passages of at least `least_words` words that repeat across texts.

    One row per passage and text: doc_id, start_word, end_word (exclusive), mate_id, mate_start, mate_end, similarity
    and kept. The mate is the earliest text found (by id) that holds the passage, or one much like it (Jaccard similarity of
    the passages' `width`-word shingles at least `percent`); kept is false. A text that is a mate has its passage too,
    as its own mate with kept = true. Words are runs of bytes outside 0x20 and 0x09-0x0D with A-Z lower-cased and are
    counted from 0. A null or empty text and one of fewer words than a passage has no rows; nor has a null id.
    Texts of any length are looked at whole. Rows
    that repeat an id are texts of one document and not compared with each other. Ids of another kind than whole
    numbers are an error. Only the two named columns are read; an empty table gives no rows.
    """
    least = least_words - width + 1
    if not 2 <= least <= FAR or hashes > 16:
        raise ValueError("passages must be longer than a shingle and of at most 1023; 16 hash functions at most")
    whole_ids(docs, key)
    spark, text = docs.sparkSession, _read(docs, key, text_col)
    first, crowded = _candidates(windows(docs, key, text_col, width, least, hashes), least, agree)
    collected(spark)
    found = _verified(text, first.withColumn("exact", F.array().cast("array<long>")), width, least, percent)
    collected(spark)
    more = _second(text, crowded, found, first, width, least)
    collected(spark)
    dropped(spark, crowded, first)
    found = found.unionByName(_verified(text, more, width, least, percent))
    about = F.struct("mate_id", "mate_start", "mate_end", "similarity")
    told = found.groupBy("doc_id", "start_word", "end_word").agg(F.min(about).alias("mate"))
    found = written(told.select("doc_id", "start_word", "end_word", "mate.*"), "passages")
    own = found.select(F.col("mate_id").alias("doc_id"), F.col("mate_start").alias("start_word"), F.col("mate_end").alias("end_word")).distinct()
    own = own.select("*", F.col("doc_id").alias("mate_id"), F.col("start_word").alias("mate_start"), F.col("end_word").alias("mate_end"), F.lit(1.0).alias("similarity"), F.lit(True).alias("kept"))
    return found.withColumn("kept", F.lit(False)).unionByName(own)


def _verified(text: DataFrame, pairs: DataFrame, width: int, least: int, percent: int) -> DataFrame:
    """The passages that pairs of texts (id, mate, shifts, exact) share: doc_id, start_word, end_word and the mate's."""
    ids = pairs.select("id").unionByName(pairs.select(F.col("mate").alias("id"))).distinct()
    used = written(text.join(ids.hint("merge"), "id", "left_semi"), "texts")
    both = pairs.join(used, "id").join(used.select(F.col("id").alias("mate"), F.col("text").alias("mate_text")), "mate")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            (x, x_off), (y, y_off) = buffers(batch.column(4)), buffers(batch.column(5))
            shifts, exact = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            last, mate_s = None, None
            for i in range(len(batch)):
                raw = y[y_off[i] : y_off[i + 1]]
                if last is None or len(raw) != len(last) or not np.array_equal(raw, last):
                    last, mate_s = raw, _text_shingles(raw, width)
                own = _text_shingles(x[x_off[i] : x_off[i + 1]], width)
                rows += [(i, p[0], p[1] + width - 1, p[2], p[3] + width - 1, p[4]) for p in _alike(own, mate_s, _enough(own, mate_s, shifts[i], exact[i], least), least, percent)]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            at = flat(np.array(columns[0], np.int64), pa.int64())
            yield pa.record_batch(
                [batch.column(0).take(at), *(pa.array(columns[k], pa.int64()) for k in (1, 2)), batch.column(1).take(at), *(pa.array(columns[k], pa.int64()) for k in (3, 4)), pa.array(columns[5], pa.float64())],
                names=["doc_id", "start_word", "end_word", "mate_id", "mate_start", "mate_end", "similarity"],
            )

    name = "doc_id long, start_word long, end_word long, mate_id long, mate_start long, mate_end long, similarity double"
    found = written(both.select("id", "mate", "shifts", "exact", "text", "mate_text").mapInArrow(verify, name), "found")
    dropped(text.sparkSession, used)
    return found


def _text_shingles(raw: np.ndarray, width: int) -> np.ndarray:
    h, _, _, first = words(raw, np.array([0, len(raw)]))
    return shingles(h, first, width)[0]


def without_repeats(docs: DataFrame, key: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with each repeated passage cut from all texts but the earliest that holds it; all rows and columns stay.

    From a text the words of its passages that aren't kept are cut, with the white space after them. Texts without
    such passages, null ones among them, are unchanged.
    """
    names, at, width = docs.columns, docs.columns.index(text_col), len(docs.columns)
    own_id, own_spans = (f"{x}-{uuid.uuid4().hex}" for x in ("id", "spans"))  # no column of docs has such a name
    cut = repeats(docs, key, text_col, **how).where("not kept")
    spans = cut.groupBy(F.col("doc_id").alias(own_id)).agg(F.array_sort(F.collect_set(F.struct("start_word", "end_word"))).alias(own_spans))
    spans = written(spans, "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, spans in enumerate(batch.column(width).to_pylist()):
                if spans and texts[i] is not None:
                    raw = texts[i].encode()
                    data = np.frombuffer(raw, np.uint8)
                    _, starts, _, _ = words(data, np.array([0, len(data)]))
                    edges = np.append(starts, len(raw))
                    gone = np.zeros(len(raw), bool)
                    for s in spans:
                        gone[edges[min(s["start_word"], len(starts))] : edges[min(s["end_word"], len(starts))]] = True
                    texts[i] = data[~gone].tobytes().decode("utf-8", "replace")
            columns = [c if k != at else pa.array(texts, pa.string()) for k, c in enumerate(batch.columns[:width])]
            yield pa.record_batch(columns, names=names)

    joined = docs.join(spans, docs[key].cast("long") == spans[own_id], "left").drop(own_id)
    return joined.mapInArrow(run, docs.schema)
