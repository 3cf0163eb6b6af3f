"""Segment features and tokens over array<struct<p, o, d>> columns (survey V1-V2h, V13, F11, helpers of 2.15).

Notes are ordered by (o, p, d) with onsets from the segment's beginning. All is higher-order functions in double
precision; nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineweave.functions.expressions import clip, quantize_signed, quantize_unit

TINY = 1e-6


def duration(notes: Column) -> Column:
    """The largest end of a note; 0 without notes."""
    return F.coalesce(F.array_max(F.transform(notes, lambda n: n.o + n.d)), F.lit(0.0))


def valid_notes(notes: Column) -> Column:
    """Whether all notes have p, o and d."""
    return F.coalesce(F.forall(notes, lambda n: n.p.isNotNull() & n.o.isNotNull() & n.d.isNotNull()), F.lit(False))


def _let(value: Column, body) -> Column:
    """body of a value that is computed once per row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, _total(values) / F.size(values)).otherwise(0.0)


def _std(values: Column) -> Column:
    squares = lambda m: _total(F.transform(values, lambda x: (x - m) * (x - m)))
    return F.when(F.size(values) > 0, F.sqrt(_let(_mean(values), squares) / F.size(values))).otherwise(0.0)


def _pitches(notes: Column) -> Column:
    return F.transform(notes, lambda n: n.p.cast("double"))


def _steps(values: Column) -> Column:
    """Differences of neighbours."""
    n = F.size(values)
    return F.when(n > 1, F.zip_with(F.slice(values, 2, F.greatest(n - 1, F.lit(1))), F.slice(values, 1, F.greatest(n - 1, F.lit(1))), lambda a, b: a - b)).otherwise(F.array().cast("array<double>"))


def _turns(iv: Column) -> Column:
    """Share of neighbouring intervals of different sign."""
    n = F.size(iv)
    length = F.greatest(n - 1, F.lit(1))
    change = F.zip_with(F.slice(iv, 1, length), F.slice(iv, 2, length), lambda a, b: (F.signum(a) != F.signum(b)).cast("double"))
    return F.when(n > 1, _mean(change)).otherwise(0.0)


def _bins(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1))


def contour(notes: Column, steps: int = 32) -> Column:
    """V1: pitch above the first note, linearly interpolated at `steps` even times from 0 to the end; ends held."""
    first = F.element_at(notes, 1).p

    def at(i: Column, end: Column) -> Column:
        t = i * end / float(steps - 1)
        between = lambda a, b: a.p + (b.p - a.p) * (t - a.o) / (b.o - a.o)
        value = lambda k: F.when(k == 0, first.cast("double")).when(k == F.size(notes), F.element_at(notes, -1).p.cast("double")).otherwise(between(F.get(notes, k - 1), F.get(notes, k)))
        return _let(F.size(F.filter(notes, lambda n: n.o <= t)), value) - first

    grid = lambda end: F.transform(_bins(steps), lambda i: at(i, end))
    return F.when(F.size(notes) > 0, _let(F.greatest(duration(notes), F.lit(TINY)), grid)).otherwise(F.array_repeat(F.lit(0.0), steps))


def intervals(notes: Column, limit: int = 12) -> Column:
    """Histogram of intervals clipped to +-limit, mean and largest size, steps, turns and number: 2 * limit + 6."""

    def of(iv: Column) -> Column:
        clipped = F.transform(iv, lambda x: clip(x, -limit, limit).cast("int") + limit)
        n = F.greatest(F.size(iv).cast("double"), F.lit(1.0))
        hist = _let(clipped, lambda all_: F.transform(_bins(2 * limit + 1), lambda b: F.size(F.filter(all_, lambda x: x == b)) / n))
        size = F.transform(iv, lambda x: F.abs(x))
        extra = F.array(_mean(size), F.coalesce(F.array_max(size), F.lit(0.0)), _mean(F.transform(size, lambda x: (x <= 2).cast("double"))), _turns(iv), F.size(iv).cast("double"))
        return F.concat(hist, extra)

    return _let(_steps(_pitches(notes)), of)


def pitch_classes(notes: Column) -> Column:
    """Durations by pitch class above the first note's, as shares."""
    total = F.greatest(_total(F.transform(notes, lambda n: n.d)), F.lit(TINY))
    first = F.element_at(notes, 1).p
    weight = lambda b: _total(F.transform(notes, lambda n: F.when(F.pmod(n.p - first, F.lit(12)) == b, n.d).otherwise(0.0))) / total
    return F.when(F.size(notes) > 0, F.transform(_bins(12), weight)).otherwise(F.array_repeat(F.lit(0.0), 12))


def rhythm(notes: Column, steps: int = 32) -> Column:
    """Shares of onsets and relative activity on a grid of `steps`, then eight statistics: 2 * steps + 8."""

    def of(end: Column) -> Column:
        place = lambda x: x / end * float(steps - 1)
        onset_bin = F.transform(notes, lambda n: F.least(F.lit(steps - 1), F.floor(place(n.o)).cast("int")))
        n = F.greatest(F.size(notes).cast("double"), F.lit(1.0))
        onset = _let(onset_bin, lambda bins: F.transform(_bins(steps), lambda b: F.size(F.filter(bins, lambda x: x == b)) / n))
        spans = F.transform(notes, lambda x: F.struct(F.floor(place(x.o)).alias("a"), F.ceil(place(x.o + x.d)).alias("b")))
        busy = _let(spans, lambda all_: F.transform(_bins(steps), lambda b: F.size(F.filter(all_, lambda x: (x.a <= b) & (x.b >= b))).cast("double")))
        activity = _let(busy, lambda x: _let(F.greatest(F.array_max(x), F.lit(1.0)), lambda most: F.transform(x, lambda y: y / most)))
        steps_o = _steps(F.transform(notes, lambda x: x.o))
        ioi = F.when(F.size(notes) > 1, F.transform(steps_o, lambda x: x / end)).otherwise(F.array(F.lit(1.0)))
        dur = F.transform(notes, lambda x: x.d / end)
        tail = lambda on: F.array(
            _let(ioi, _mean), _let(ioi, _std), _let(dur, _mean), _let(dur, _std), F.greatest(F.lit(0.0), 1.0 - _total(dur) / end), F.size(notes) / end,
            F.when(F.size(notes) > 2, _mean(F.transform(steps_o, lambda x: F.abs(x)))).otherwise(0.0), _mean(F.transform(on, lambda x: (x > 0).cast("double"))),
        )
        return _let(onset, lambda on: F.concat(on, activity, tail(on)))

    return F.when(F.size(notes) > 0, _let(F.greatest(duration(notes), F.lit(TINY)), of)).otherwise(F.array_repeat(F.lit(0.0), 2 * steps + 8))


def shape(notes: Column, bars: Column) -> Column:
    """V2d: log number, range, mean interval size, turns, share of rests, bars, last duration over first."""
    p = _pitches(notes)
    iv = _steps(p)
    rest = F.greatest(F.lit(0.0), 1.0 - _total(F.transform(notes, lambda n: n.d)) / F.greatest(F.lit(TINY), duration(notes)))
    out = F.array(
        F.log1p(F.size(notes).cast("double")), F.array_max(p) - F.array_min(p), _mean(F.transform(iv, lambda x: F.abs(x))), _turns(iv), rest, bars.cast("double"),
        F.element_at(notes, -1).d / F.greatest(F.lit(TINY), F.element_at(notes, 1).d),
    )
    return F.when(F.size(notes) > 0, out).otherwise(F.array_repeat(F.lit(0.0), 7))


def assembled(segments: DataFrame, notes: str = "notes", bars: str = "n_bars") -> DataFrame:
    """V2e: adds melody (74), rhythm (72) and combined (153) vectors."""
    n = F.col(notes)
    out = segments.withColumn("melody", F.concat(contour(n), intervals(n), pitch_classes(n))).withColumn("rhythm", rhythm(n))
    return out.withColumn("combined", F.concat("melody", "rhythm", shape(n, F.col(bars))))


def standardized(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """V2f, A23: (key, at, z): each component less its mean, by its population deviation (1 where that is 0)."""
    each = vectors.select(key, F.posexplode(vector).alias("at", "x"))
    fit = each.groupBy("at").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    scaled = each.join(F.broadcast(fit), "at")  # one row per component
    return scaled.select(key, "at", ((F.col("x") - F.col("mean")) / F.when(F.col("std") > 1e-12, F.col("std")).otherwise(1.0)).alias("z"))


def tokens(notes: Column, most: int = 96, pitch: int = 48, interval: int = 24, onset: int = 128, length: int = 64, ioi: int = 64, pad: bool = False) -> Column:
    """Five tokens per note (pitch above the first, interval, onset, duration, time since the last onset).

    Null for segments of more than `most` notes, empty without notes or duration; padded with zeros if asked for.
    """
    total, first = duration(notes), F.element_at(notes, 1)

    def one(n: Column, i: Column) -> Column:
        last = F.get(notes, i - 1)
        return F.array(
            quantize_signed(n.p - first.p, pitch), quantize_signed(F.when(i == 0, 0).otherwise(n.p - last.p), interval), quantize_unit((n.o - first.o) / total, onset),
            quantize_unit(n.d / total, length), quantize_unit(F.when(i == 0, 0.0).otherwise((n.o - last.o) / total), ioi),
        )

    out = F.when(F.size(notes) > most, F.lit(None)).when((F.size(notes) == 0) | (total <= 0), F.array().cast("array<array<int>>")).otherwise(F.transform(notes, one))
    if pad:
        out = F.concat(out, F.array_repeat(F.array_repeat(F.lit(0), 5), F.greatest(F.lit(0), F.lit(most) - F.size(out))))
    return out
