"""Scalar, array and statistic expressions (survey ids F1-F15, P2, P3, P15, A17, M10, V2h). All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spellings that count as true, after lower-casing and without trimming.
TRUE_WORDS = ["1", "true", "t", "yes", "y"]


def boolize(c: Column) -> Column:
    """Whether the value's text is one of TRUE_WORDS; null counts as false."""
    return F.coalesce(F.lower(c.cast("string")).isin(TRUE_WORDS), F.lit(False))


def numeric(c: Column) -> Column:
    """A number, 0 for null and for what isn't one."""
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def quality(rating: Column, views: Column, favorites: Column, ratings: Column) -> Column:
    """Rating plus small weights for attention."""
    return numeric(rating) + numeric(views) * 0.001 + numeric(favorites) * 0.01 + numeric(ratings) * 0.1


def segment_id(score: Column, part: Column, voice: Column, start: Column, end: Column) -> Column:
    """sixteen hex digits that identify a segment of a line."""
    return F.substring(F.sha1(F.format_string("%s|%s|%s|%.6f|%.6f", score, part, voice, start, end)), 1, 16)


def path_id(path: Column) -> Column:
    """sixteen hex digits of a path."""
    return F.substring(F.sha1(path), 1, 16)


def utc_now() -> Column:
    """F8: the time of the query in UTC, as ISO text that sorts by time."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def run_id(utc: Column, settings: Column) -> Column:
    """a run's name from its time, a timestamp in UTC, and the checksum of its settings."""
    return F.concat(F.date_format(utc, "yyyyMMdd'T'HHmmss'Z'"), F.lit("_"), F.substring(settings, 1, 8))


def unit_hash(seed: int, key: Column) -> Column:
    """a number in [0, 1] that depends on seed and key only."""
    return F.conv(F.substring(F.sha1(F.concat_ws("|", F.lit(str(seed)), key.cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def hash_split(seed: int, key: Column, train: float, validation: float) -> Column:
    """train, validation or test; all rows of a key fall alike."""
    x = unit_hash(seed, key)
    return F.when(x < train, "train").when(x < train + validation, "validation").otherwise("test")


def set_checksum(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """(keys, checksum, n): one checksum of each key's values whatever their order, from sums over hashes."""
    h = F.sha1(value.cast("string"))
    part = lambda at, n: F.conv(F.substring(h, at, n), 16, 10).cast("long")
    sums = rows.select(*keys, part(1, 15).alias("_a"), part(16, 8).alias("_b")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.bit_xor("_a").alias("_a"), F.sum("_b").alias("_b"))
    return sums.select(*keys, F.sha1(F.concat_ws("|", *[F.col(c).cast("string") for c in ("n", "_a", "_b")])).alias("checksum"), "n")


def hash_order(seed: int, key: Column) -> Column:
    """An order of keys that looks random but depends on seed and key only."""
    return F.sha1(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))


def token_name(prefix: str, cluster: Column, width: int = 4) -> Column:
    """Like M_0007; wider numbers keep all digits."""
    return F.format_string(f"{prefix}_%0{width}d", cluster)


def rounded(c: Column, places: int = 6) -> Column:
    """Rounded as SQL engines on binary numbers do: the scaled value to the nearest whole number, halves away from 0.

    F.round rounds the decimal text, so that a number written 64.9472225, which scales to just under a half, goes up.
    """
    scale = 10.0**places
    return F.round(c * F.lit(scale), 0) / F.lit(scale)


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def quantize_signed(value: Column, limit: int, below: int = 2, above: int = 3, first: int = 4) -> Column:
    """A whole number within +-limit as a token, others as one of two overflow tokens."""
    return F.when(value < -limit, below).when(value > limit, above).otherwise(value.cast("int") + limit + first)


def quantize_unit(value: Column, bins: int, first: int = 2) -> Column:
    """A share of 1 as one of `bins` tokens, rounded half to even."""
    return (F.bround(clip(value, 0.0, 1.0) * F.lit(float(bins - 1)), 0).cast("int") + first) if bins > 1 else F.lit(first)


def upper_median(values: Column) -> Column:
    """The middle of the sorted array, the upper one of two; null if empty."""
    s = F.array_sort(values)
    return F.get(s, F.floor(F.size(s) / 2).cast("int"))


def dot(a: Column, b: Column) -> Column:
    """In double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column) -> Column:
    """V2h: divided by its length, of 1e-8 at least."""
    n = F.greatest(norm(a), F.lit(1e-8))
    # bound to a lambda's variable, the length is computed once; inside the inner one it would be for each component
    return F.get(F.transform(F.array(n), lambda m: F.transform(a, lambda x: x.cast("double") / m)), F.lit(0))


def valid_vector(a: Column) -> Column:
    """Not null, all components finite, length above 0."""
    inf = float("inf")
    finite = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (x != F.lit(inf)) & (x != F.lit(-inf)))
    return F.coalesce(a.isNotNull() & finite & (norm(a) > 0) & (norm(a) < F.lit(inf)), F.lit(False))


def wilson(wins: Column, total: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The interval of a share, within [0, 1]; (0, 0) without trials."""
    n = F.greatest(total.cast("double"), F.lit(1.0))
    p = wins.cast("double") / n
    middle = p + z * z / (2 * n)
    spread = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    low, high = F.greatest(F.lit(0.0), (middle - spread) / scale), F.least(F.lit(1.0), (middle + spread) / scale)
    return F.when(total > 0, low).otherwise(0.0), F.when(total > 0, high).otherwise(0.0)


def length_penalty(bars: Column, least: float, liked: float, soft: float, hard: float) -> Column:
    """1000 above the hard limit, linear below the least, else quadratic around the liked length."""
    over = F.greatest(F.lit(0.0), bars - soft)
    return F.when(bars > hard, 1000.0).when(bars < least, (least - bars) * 4.0).otherwise((bars - liked) * (bars - liked) * 0.12 + over * over * 0.25)


def cadence_strength(before: Column, after: Column, tonic: Column) -> Column:
    """M8: a step pair onto the tonic or third counts 1, the bare tonic .5, the dominant .3; null pitches or tonic 0."""
    b, a = F.pmod(before - tonic, F.lit(12)), F.pmod(after - tonic, F.lit(12))
    pair = ((b == 2) | (b == 11) | (b == 7)) & (a == 0) | (b == 5) & (a == 4)
    return F.when(before.isNull() | after.isNull() | tonic.isNull(), 0.0).when(pair, 1.0).when(a == 0, 0.5).when(a == 7, 0.3).otherwise(0.0)


def frequency(pitch: Column) -> Column:
    """hertz of a semitone number, 69 being 440."""
    return F.pow(F.lit(2.0), (pitch - 69) / 12.0) * 440.0


def seconds(beats: Column, per_minute: float) -> Column:
    """F15."""
    return beats * 60.0 / per_minute


def ticks(beats: Column, per_beat: int, per_minute: float) -> Column:
    """rounded half to even, as the renderer scales them."""
    return F.bround(beats * per_beat * per_minute / 60.0, 0).cast("long")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def entropy(count: Column, total: Column) -> Column:
    """One term of -sum p ln p."""
    p = count / total
    return -(p * F.ln(F.greatest(p, F.lit(1e-12))))
