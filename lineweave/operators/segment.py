"""Best segmentation of a line by dynamic programming (survey M11, M10, M12).

The recurrence over cuts is sequential within a line, so lines are folded in Python, one line a group; a line is a
bounded thing (a part of one piece), and lines spread over tasks by key.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.functions import udtf


@dataclass(frozen=True)
class Limits:
    min_bars: float = 1.5
    preferred_bars: float = 4.0
    soft_max_bars: float = 8.0
    hard_max_bars: float = 12.0
    min_notes: int = 4
    split_penalty: float = 0.7


def penalties(bars: np.ndarray, limits: Limits) -> np.ndarray:
    """What segments of these lengths cost."""
    fair = 0.12 * (bars - limits.preferred_bars) ** 2 + 0.25 * np.maximum(0.0, bars - limits.soft_max_bars) ** 2
    return np.where(bars > limits.hard_max_bars, 1000.0, np.where(bars < limits.min_bars, 4.0 * (limits.min_bars - bars), fair))


def _reached(score, gains, t, first, after, lo: int, j: int, n: int, unit: float, limits: Limits) -> np.ndarray:
    """What a segment that ends at j makes of each start from lo on."""
    bars = np.maximum(0.0, (t[j] - t[lo:j]) / unit)
    s = score[lo:j] + gains[j] - penalties(bars, limits) - np.where(np.arange(lo, j) > 0, limits.split_penalty, 0.0)
    if j != n - 1:
        s[after[j] - first[lo:j] < limits.min_notes] = -np.inf
    return s


def best_cuts(times: list[float], gain: list[float], onsets: list[float], measure: float, limits: Limits) -> list[int]:
    """Indexes into times of the cuts, first and last included, that make the most of evidence less penalties.

    A segment from i to j holds the notes with onset in [i, j], both ends included within a millionth, and must have
    min_notes of them unless j is the end. Equal scores keep the earlier start. If the end can't be reached the whole
    line is one segment.
    """
    n = len(times)
    t, gains, at = np.array(times), np.array(gain), np.array(onsets)
    first, after = np.searchsorted(at, t - 1e-6), np.searchsorted(at, t + 1e-6)
    score, back = np.full(n, -np.inf), np.zeros(n, int)
    score[0] = 0.0
    unit = max(1e-6, measure)
    # starts further back than the hard limit all pay the same large penalty: where even the best of them can't
    # reach what a start within the limit gives, they need no look
    near = np.searchsorted(t, t - (limits.hard_max_bars + 1e-6) * unit)
    best = -np.inf
    k = 0  # score[:k] have gone into best
    for j in range(1, n):
        while k < near[j]:
            best, k = max(best, score[k]), k + 1
        for lo in (near[j], 0):
            s = _reached(score, gains, t, first, after, lo, j, n, unit, limits)
            i = int(np.argmax(s)) if len(s) else 0
            if lo == 0 or (len(s) and s[i] > best + gains[j] - 1000.0):
                break
        if len(s) and s[i] > -1e9:
            score[j], back[j] = s[i], lo + i
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


def line_segments(times: list[float], evidence: list[float], onsets: list[float], measure: float, limits: Limits) -> list[tuple[float, float, int, float]]:
    """(start, end, notes, bars) of one line's segments, as segment_lines() says."""
    out = []
    if len(onsets) < limits.min_notes or len(times) < 2:
        return out
    cuts = best_cuts(times, evidence, onsets, measure, limits)
    for a, b in zip(cuts, cuts[1:], strict=False):
        notes = bisect.bisect_left(onsets, times[b] + 1e-6) - bisect.bisect_left(onsets, times[a] - 1e-6)
        bars = (times[b] - times[a]) / measure
        if notes >= 4 and times[b] - times[a] > 1e-6 and bars <= limits.hard_max_bars:
            out.append((times[a], times[b], notes, bars))
    return out


class SegmentLine:
    """segment_line of SQL: a table of one line's candidate cuts and onsets to its segments.

    Takes rows (line, measure_length, times, evidence, onsets) with arrays of a line's candidate cuts, of what speaks for
    each and of its notes' onsets, or rows (line, measure_length, t, evidence, onset) of one of each: there a candidate cut
    has t and evidence, a note has onset, a row may be both. Each row is a call into Python, so arrays are the form for
    large tables. PARTITION BY line gives each line a call of its own; rows may come in any order.
    """

    def __init__(self) -> None:
        self.line, self.measure, self.cuts, self.onsets = None, None, [], []

    def eval(self, row: Row) -> None:
        self.line, self.measure = row["line"], row["measure_length"]
        if "times" in row:
            times = row["times"] or []
            self.cuts += [(t, e or 0.0) for t, e in zip(times, row["evidence"] or [0.0] * len(times), strict=True) if t is not None]
            self.onsets += [o for o in row["onsets"] or [] if o is not None]
            return
        if row["t"] is not None:
            self.cuts.append((row["t"], row["evidence"] or 0.0))
        if row["onset"] is not None:
            self.onsets.append(row["onset"])

    def terminate(self) -> Iterator[tuple]:
        cuts = sorted(self.cuts)
        for found in line_segments([t for t, _ in cuts], [e for _, e in cuts], sorted(self.onsets), self.measure, Limits()):
            yield (self.line, *found)


def register(spark: SparkSession, name: str = "segment_line") -> None:
    """M11 in SQL: SELECT * FROM segment_line(TABLE(t) PARTITION BY line)."""
    spark.udtf.register(name, udtf(SegmentLine, returnType="line string, start_q double, end_q double, n_notes bigint, n_bars double"))


def segment_lines(candidates: DataFrame, key: str, limits: Limits = Limits()) -> DataFrame:
    """(key, start_q, end_q, n_notes, n_bars) of each line's segments.

    candidates: key, measure_length, times (sorted candidate cuts from 0 to the end), evidence (parallel to times),
    onsets (sorted). Segments of under four notes, of no length, or above the hard limit are left out; lines of
    fewer than min_notes have none.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(getattr(line, key), *r) for line in pdf.itertuples(index=False) for r in line_segments(list(line.times), list(line.evidence), list(line.onsets), line.measure_length, limits)]
        return pd.DataFrame(rows, columns=[key, "start_q", "end_q", "n_notes", "n_bars"])

    kind = candidates.schema[key].dataType.simpleString()
    # one row per line: the work lies in the fold, so lines are spread over all tasks, however few bytes they have
    tasks = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return candidates.select(key, "measure_length", "times", "evidence", "onsets").repartition(tasks, key).mapInPandas(lambda it: (fold(p) for p in it), f"{key} {kind}, start_q double, end_q double, n_notes long, n_bars double")
