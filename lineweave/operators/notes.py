"""Note lines: windows, ties, skyline, measures, candidates and boundary evidence (survey M1-M9, W3-W6, W8, J14, U3).

A note table has one row per note: the line's key columns, o (onset), p (pitch), d (duration) and, where asked for,
measure and tie. All steps are windows by line, so a line's notes meet in one sort but never in one row or in Python.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.config import DEFAULTS
from lineweave.functions.expressions import cadence_strength, upper_median

EPS = 1e-6
WEIGHTS = DEFAULTS["boundary_weights"]
# Published tone profiles of keys (Krumhansl and Kessler), from the tonic up.
MAJOR = [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]
MINOR = [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]


@dataclass(frozen=True)
class Line:
    """The columns that name a line."""

    keys: list[str] = field(default_factory=lambda: ["score_id"])

    def ordered(self):
        return Window.partitionBy(*self.keys).orderBy("o", F.desc("p"), "d")


def highest(notes: DataFrame, line: Line) -> DataFrame:
    """M1, M3: per onset the highest pitch, and of that onset the longest duration."""
    return notes.groupBy(*line.keys, "o").agg(F.max("p").alias("p"), F.max("d").alias("d"))


def merged_ties(notes: DataFrame, line: Line) -> DataFrame:
    """A note tied to one of equal pitch that it touches becomes one note with it.

    A tie chain is an island: a note opens one unless it continues the note before. Its end is its last member's.
    """
    w = line.ordered()
    rows = notes.withColumn("_pp", F.lag("p").over(w)).withColumn("_pe", F.lag(F.col("o") + F.col("d")).over(w))
    goes_on = (F.col("p") == F.col("_pp")) & F.coalesce(F.col("tie").isin("continue", "stop"), F.lit(False)) & (F.col("o") <= F.col("_pe") + EPS)
    rows = rows.withColumn("_i", F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    end = F.max_by(F.col("o") + F.col("d"), F.col("o"))
    out = rows.groupBy(*line.keys, "_i").agg(F.min("o").alias("o"), F.min_by("p", "o").alias("p"), end.alias("_e"))
    return out.select(*line.keys, "o", "p", (F.col("_e") - F.col("o")).alias("d"))


def skyline(notes: DataFrame, line: Line) -> DataFrame:
    """M3: the top line: onsets with the same top pitch that touch the island so far join it."""
    top = highest(notes, line)
    w = Window.partitionBy(*line.keys).orderBy("o")
    rows = top.withColumn("_pp", F.lag("p").over(w))
    # an island's end is the largest end since its pitch began: runs of one pitch first, gaps inside a run after
    rows = rows.withColumn("_r", F.sum(F.when(F.col("p") == F.col("_pp"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    r = Window.partitionBy(*line.keys, "_r").orderBy("o")
    rows = rows.withColumn("_end", F.max(F.col("o") + F.col("d")).over(r.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_g", F.sum(F.when(F.col("o") > F.col("_end") + EPS, 1).otherwise(0)).over(r.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.groupBy(*line.keys, "_r", "_g").agg(F.min("o").alias("o"), F.min("p").alias("p"), F.max(F.col("o") + F.col("d")).alias("_e"))
    return out.select(*line.keys, "o", "p", (F.col("_e") - F.col("o")).alias("d"))


def lines(notes: DataFrame, part: list[str], least: int = 12) -> DataFrame:
    """M4: a part's explicit voices of at least `least` notes, else its skyline; percussion is left out.

    notes: part columns, voice_id (null without one), percussion, o, p, d, tie. Adds line_id and extraction_mode.
    """
    heard = notes.where("not coalesce(percussion, false)")
    voiced = Line([*part, "voice_id"])
    own = heard.where("voice_id is not null")
    top = own.groupBy(*voiced.keys, "o").agg(F.max_by(F.struct("p", "d", "tie"), "p").alias("n")).select(*voiced.keys, "o", "n.*")
    explicit = _long_enough(merged_ties(top, voiced), voiced, least).withColumnRenamed("voice_id", "line_id").withColumn("extraction_mode", F.lit("explicit_voice"))
    rest = heard.join(explicit.select(*part).distinct(), part, "left_anti")
    sky = _long_enough(skyline(rest, Line(part)), Line(part), least)
    return explicit.unionByName(sky.withColumn("line_id", F.lit("skyline")).withColumn("extraction_mode", F.lit("skyline")))


def _long_enough(notes: DataFrame, line: Line, least: int) -> DataFrame:
    keep = notes.groupBy(*line.keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).drop("_n")
    return notes.join(keep, line.keys, "left_semi")


def measure_length(notes: DataFrame, line: Line) -> DataFrame:
    """M5: per line the upper median of onset steps per measure step; else a quarter of the span, 1 at least; else 4."""
    w = line.ordered()
    dm, do = F.lead("measure").over(w) - F.col("measure"), F.lead("o").over(w) - F.col("o")
    spans = notes.select(*line.keys, "o", "p", "d", F.when((dm > 0) & (do > 0), do / dm).alias("_s"))
    out = spans.groupBy(*line.keys).agg(
        F.sort_array(F.collect_list("_s")).alias("_l"), F.count(F.lit(1)).alias("_n"),
        (F.max_by(F.col("o") + F.col("d"), F.struct("o", -F.col("p"), "d")) - F.min("o")).alias("_span"),
    )
    length = F.when(F.size("_l") > 0, upper_median(F.col("_l"))).when(F.col("_n") < 2, 4.0).otherwise(F.greatest(F.lit(1.0), F.col("_span") / 4.0))
    return out.select(*line.keys, length.alias("measure_length"))


def candidate_times(notes: DataFrame, line: Line) -> DataFrame:
    """0, the line's end, and all onsets rounded to six places, each once."""
    w = line.ordered()
    last = F.row_number().over(Window.partitionBy(*line.keys).orderBy(F.desc("o"), "p", F.desc("d"))) == 1
    times = notes.select(*line.keys, F.array(F.round("o", 6), F.when(last, F.col("o") + F.col("d"))).alias("_t"), F.row_number().over(w).alias("_k"))
    each = times.select(*line.keys, F.explode(F.concat(F.filter("_t", lambda t: t.isNotNull()), F.when(F.col("_k") == 1, F.array(F.lit(0.0))).otherwise(F.array().cast("array<double>")))).alias("t"))
    return each.distinct()


def local_median(notes: DataFrame, line: Line, reach: int = 3) -> DataFrame:
    """The upper median of the positive durations from `reach` notes before to `reach` after; else the own one."""
    w = line.ordered().rowsBetween(-reach, reach)
    around = F.filter(F.collect_list("d").over(w), lambda d: d > 0)
    return notes.withColumn("local_median", F.coalesce(upper_median(around), F.col("d")))


def key_of(notes: DataFrame, line: Line, first: int = 64) -> DataFrame:
    """M9: tonic (0-11) and mode whose profile correlates best with the pitch classes of the first notes."""
    early = notes.withColumn("_k", F.row_number().over(line.ordered())).where(F.col("_k") <= first)
    counts = early.groupBy(*line.keys).agg(*[F.count_if(F.pmod("p", F.lit(12)) == k).cast("double").alias(f"_c{k}") for k in range(12)])
    counted = counts.select(*line.keys, F.array(*[f"_c{k}" for k in range(12)]).alias("_c"))
    options = []
    for mode, profile in (("major", MAJOR), ("minor", MINOR)):
        mean = sum(profile) / 12
        length = sum((x - mean) ** 2 for x in profile) ** 0.5
        for tonic in range(12):
            turned = [(profile[(k - tonic) % 12] - mean) / length for k in range(12)]
            fit = sum((F.col("_c")[k] * turned[k] for k in range(12)), F.lit(0.0))
            options.append(F.struct(F.round(fit, 9).alias("fit"), F.lit(-tonic).alias("low"), F.lit(mode).alias("mode")))
    return counted.select(*line.keys, F.array_max(F.array(*options)).alias("_b")).select(*line.keys, (-F.col("_b.low")).alias("tonic"), F.col("_b.mode").alias("mode"))


def rest_tier(gap: Column) -> Column:
    return F.when(gap < 0.25, 0.0).when(gap < 0.5, 0.3).when(gap < 1.0, 0.6).otherwise(1.0)


def boundary_evidence(notes: DataFrame, line: Line, weights: dict[str, float] | None = None, tonic: Column | None = None) -> DataFrame:
    """M7: the cues for a cut before each note but the first, and their weighted sum as evidence.

    The note before a cut is the last one that has ended by then, so a note that still sounds is passed over, and a
    cut before which none has ended has no row; the note after is the row itself (J14, W6). The agogic cue compares
    with the local median around the row before; slur ends and section markers are never set by the sources at hand
    and count 0.
    """
    weight = weights or WEIGHTS
    w = line.ordered()
    rows = local_median(notes, line).withColumn("_l1", F.lag("local_median").over(w)).withColumn("_pn", F.lead("p").over(w))
    rows = _ended_before(rows, line).where("_o1 is not null")
    gap = F.greatest(F.lit(0.0), F.col("o") - (F.col("_o1") + F.col("_d1")))
    before, after = F.signum(F.col("_p1") - F.col("_p2")), F.signum(F.col("_pn") - F.col("p"))
    cues = {
        "rest_before": rest_tier(gap),
        "agogic_before": F.when(F.col("_d1") >= F.col("_l1") * 1.5, F.least(F.lit(1.0), F.col("_d1") / F.greatest(F.col("_l1"), F.lit(EPS)) - 1.0)).otherwise(0.0),
        "metric_strength": F.when(F.col("measure") > F.col("_m1"), 0.5).otherwise(0.0),
        "leap_after": F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.abs(F.col("p") - F.col("_p1")) - 2) / 10.0)),
        "contour_change": F.coalesce(F.when((before != 0) & (after != 0) & (before != after), 1.0), F.lit(0.0)),
        "cadence": cadence_strength(F.col("_p1"), F.col("p"), tonic) if tonic is not None else F.lit(0.0),
        "slur_end": F.lit(0.0),
        "section_marker": F.lit(0.0),
    }
    rows = rows.withColumns({k: c.cast("double") for k, c in cues.items()})
    total = sum((F.col(k) * weight.get(k, 0.0) for k in cues), F.lit(0.0))
    return rows.select(*line.keys, "o", "p", *cues, total.alias("evidence"))


def _ended_before(notes: DataFrame, line: Line) -> DataFrame:
    """Adds _p1, _d1, _o1, _m1 of the last note (in line order) that has ended by each onset, and _p2 of the one before.

    Ends and onsets run through one sort. An end lies EPS early but never before its own note's onset, and among equal
    times marks come in line order, a note's onset first: however short, a note ends before later notes only, never
    before itself. The second largest of a running set is the running maximum of what each newcomer or the largest so
    far, whichever is smaller, leaves behind.
    """
    own = F.struct(F.row_number().over(line.ordered()).alias("k"), "p", "d", "o", "measure")
    marks = F.array(F.struct(F.greatest("o", F.col("o") + F.col("d") - EPS).alias("at"), F.lit(1).alias("kind")), F.struct(F.col("o").alias("at"), F.lit(0).alias("kind")))
    each = notes.withColumn("_own", own).withColumn("_mark", F.explode(marks)).withColumn("_end", F.when(F.col("_mark.kind") == 1, F.col("_own")))
    time = Window.partitionBy(*line.keys).orderBy("_mark.at", "_own.k", "_mark.kind")
    before = time.rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("_first", F.max("_end").over(before))
    left = F.when(F.col("_end").isNotNull() & F.col("_first").isNotNull(), F.least("_end", "_first"))
    each = each.withColumn("_left", left).withColumn("_second", F.max("_left").over(before)).where("_mark.kind = 0")
    found = {"_p1": "_first.p", "_d1": "_first.d", "_o1": "_first.o", "_m1": "_first.measure", "_p2": "_second.p"}
    return each.withColumns({k: F.col(c) for k, c in found.items()}).drop("_own", "_mark", "_end", "_first", "_left", "_second")


def gap_segments(notes: DataFrame, line: Line, rest: float = 2.0) -> DataFrame:
    """A segment ends where the next note comes `rest` or more after the end of this one."""
    w = line.ordered()
    rows = notes.withColumn("_pe", F.lag(F.col("o") + F.col("d")).over(w))
    rows = rows.withColumn("segment", F.sum(F.when(F.col("o") - F.col("_pe") >= rest, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.drop("_pe")


def ordered_notes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per segment with its notes by (o, p, d), onsets from the segment's first: array<struct<p, o, d>>."""
    packed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("o", "p", "d"))).alias("_n"), F.min("o").alias("start_q"), F.max(F.col("o") + F.col("d")).alias("end_q"))
    note = F.transform("_n", lambda n: F.struct(n.p.alias("p"), (n.o - F.col("start_q")).alias("o"), n.d.alias("d")))
    return packed.select(*keys, "start_q", "end_q", note.alias("notes"))


def render_events(notes: DataFrame, line: Line, per_beat: int = 480) -> DataFrame:
    """Note-on and note-off events by tick; at equal ticks offs come before ons."""
    kinds = F.array(F.struct(F.col("o").alias("at"), F.lit(1).alias("on")), F.struct((F.col("o") + F.col("d")).alias("at"), F.lit(0).alias("on")))
    each = notes.select(*line.keys, "p", F.explode(kinds).alias("e"))
    return each.select(*line.keys, "p", F.bround(F.col("e.at") * per_beat, 0).cast("long").alias("tick"), F.col("e.on").alias("note_on"))


def roll_extent(notes: DataFrame, line: Line) -> DataFrame:
    """Piano-roll limits: lowest pitch - 2, highest + 2, last end."""
    return notes.groupBy(*line.keys).agg((F.min("p") - 2).alias("low"), (F.max("p") + 2).alias("high"), F.max(F.col("o") + F.col("d")).alias("end_q"))


def cue_frequency(evidence: DataFrame, cues: list[str] | None = None) -> DataFrame:
    """A2: (cue, n): in how many rows each cue isn't zero."""
    names = cues or list(WEIGHTS)
    given = F.map_filter(F.create_map(*[x for c in names for x in (F.lit(c), F.col(c))]), lambda k, v: v != 0)
    return evidence.select(F.explode(given).alias("cue", "v")).groupBy("cue").agg(F.count(F.lit(1)).alias("n"))
