"""Queries over note lines derived from the event table, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineweave.functions.expressions import rounded
from lineweave.operators import features as V
from lineweave.operators import notes as N
from lineweave.plans.catalog_queries import table

LINE = N.Line(["score_id"])


def notes(spark, d) -> DataFrame:
    """events as notes: a line per user, six hours as the unit of time, pitch from the event's k."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("us"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    n = e.select(F.col("user_id").alias("score_id"), F.col("event_type").alias("part"), (F.lit(48) + F.col("k") % 37).alias("p"), ((F.col("us") - F.min("us").over(Window.partitionBy("user_id"))) / F.lit(21600000000.0)).alias("o"), ((F.lead("us").over(w) - F.col("us")) / F.lit(21600000000.0)).alias("gap"))
    return n.select("score_id", "part", "p", "o", F.least(F.coalesce("gap", F.lit(1.0)), F.lit(1.0)).alias("d"), (F.floor(F.col("o") / 4) + 1).cast("int").alias("measure"))


_N = """e as (select user_id as score_id, event_id, event_type as part, epoch_us(ts) as us, (props->>'$.k')::int as k from events),
notes as (select score_id, part, 48 + k % 37 as p, (us - min(us) over (partition by score_id)) / 21600000000.0::double as o,
  least(coalesce((lead(us) over (partition by score_id order by us, event_id) - us) / 21600000000.0::double, 1.0::double), 1.0::double) as d from e),
n as (select *, floor(o / 4)::int + 1 as measure from notes)"""
_W = "partition by score_id order by o, p desc, d"
_SEG = f"""{_N}, g as (select *, lag(o + d) over ({_W}) as pe from n),
s as (select score_id, part, p, o, d, measure, sum(case when o - pe >= 2 then 1 else 0 end) over ({_W} rows between unbounded preceding and current row)::bigint as segment from g)"""


def _r(c, name):
    return rounded(F.col(c)).alias(name)


def notes_derive(spark, d):
    return notes(spark, d).select("score_id", "part", "p", _r("o", "o"), _r("d", "d"), "measure")


def cut_notes(spark, d):
    return N.gap_segments(notes(spark, d), LINE)


def gap_segments(spark, d):
    from lineweave.functions.expressions import segment_id

    s = N.ordered_notes(cut_notes(spark, d), ["score_id", "segment"])
    sid = segment_id(F.col("score_id"), F.lit("part"), F.lit("0"), rounded(F.col("start_q")), rounded(F.col("end_q")))
    return s.select("score_id", "segment", _r("start_q", "start_q"), _r("end_q", "end_q"), F.size("notes").alias("n_notes"), sid.alias("segment_id"))


def segments(spark, d):
    s = N.ordered_notes(cut_notes(spark, d), ["score_id", "segment"])
    return s.where(F.size("notes") >= 4).withColumn("n_bars", (F.col("end_q") - F.col("start_q")) / 4.0)


_PH = f"""{_SEG}, ph as (select score_id, segment, min(o) as start_q, max(o + d) as end_q, list(p order by o, p, d) as ps, list(o order by o, p, d) as os0, list(d order by o, p, d) as ds
  from s group by all having count(*) >= 4),
q as (select score_id, segment, (end_q - start_q) / 4.0::double as bars, ps, list_transform(os0, lambda x: x - start_q) as os, ds, end_q - start_q as dur,
  list_transform(range(1, len(ps)), lambda i: ps[i + 1] - ps[i]) as iv from ph)"""


def local_median(spark, d):
    return N.local_median(notes(spark, d), LINE).select("score_id", _r("o", "o"), _r("local_median", "local_median"))


def measure_length(spark, d):
    return N.measure_length(notes(spark, d), LINE).select("score_id", _r("measure_length", "measure_length"))


def candidate_times(spark, d):
    return N.candidate_times(notes(spark, d), LINE).groupBy("score_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("t"), 6).alias("last"))


def boundary_evidence(spark, d):
    b = N.boundary_evidence(notes(spark, d), LINE, tonic=F.lit(0))
    return b.select("score_id", _r("o", "o"), *[_r(c, c) for c in ("rest_before", "agogic_before", "metric_strength", "leap_after", "contour_change", "cadence", "evidence")])


def cue_frequency(spark, d):
    b = N.boundary_evidence(notes(spark, d), LINE, tonic=F.lit(0))
    return N.cue_frequency(b)


def key_estimate(spark, d):
    return N.key_of(notes(spark, d), LINE)


def skyline(spark, d):
    held = notes(spark, d).withColumn("o", F.floor(F.col("o")).cast("double")).withColumn("p", (F.floor(F.col("p") / 12) * 12).cast("int"))
    return N.skyline(held, LINE).select("score_id", "p", _r("o", "o"), _r("d", "d"))


def merged_ties(spark, d):
    tied = notes(spark, d).withColumn("p", F.lit(60)).withColumn("tie", F.when(F.col("measure") % 2 == 0, "continue"))
    return N.merged_ties(tied, LINE).select("score_id", "p", _r("o", "o"), _r("d", "d"))


def line_policy(spark, d):
    n = notes(spark, d).withColumn("voice_id", F.when(F.col("part").isin("click", "view"), F.col("part"))).withColumn("percussion", F.col("part") == "logout").withColumn("tie", F.lit(None).cast("string"))
    out = N.lines(n, ["score_id"], 12)
    return out.groupBy("extraction_mode", "line_id").agg(F.count(F.lit(1)).alias("notes"), F.countDistinct("score_id").alias("scores"), F.round(F.sum("d"), 4).alias("length"))


def render_events(spark, d):
    return N.render_events(notes(spark, d), LINE)


def roll_extent(spark, d):
    return N.roll_extent(notes(spark, d), LINE).select("score_id", "low", "high", _r("end_q", "end_q"))


def extraction_summary(spark, d):
    s = segments(spark, d)
    per = s.groupBy("score_id").agg(F.count(F.lit(1)).alias("k"))
    a = s.agg(F.count(F.lit(1)).alias("segments"), F.countDistinct("score_id").alias("scores"), F.round(F.median("n_bars"), 6).alias("median_bars"), F.round(F.avg((F.size("notes") >= 8).cast("double")), 6).alias("long_share"))
    b = per.agg(F.median("k").alias("median_per_score"))
    return a.join(b.hint("broadcast"))


def histogram_bars(spark, d):
    from lineweave.operators.diagnostics import histogram

    return histogram(segments(spark, d), F.col("n_bars"), 20).select("bin", "n")


def _vector(spark, d, make):
    s = segments(spark, d)
    return s.select("score_id", "segment", F.array_join(F.transform(make(s), lambda x: F.format_string("%.4f", F.round(x, 4) + 0.0)), ",").alias("vector"))


def interval_features(spark, d):
    return _vector(spark, d, lambda s: V.intervals(F.col("notes")))


def pitch_class_profile(spark, d):
    return _vector(spark, d, lambda s: V.pitch_classes(F.col("notes")))


def shape_features(spark, d):
    return _vector(spark, d, lambda s: V.shape(F.col("notes"), F.col("n_bars")))


def contour(spark, d):
    return _vector(spark, d, lambda s: V.contour(F.col("notes")))


def rhythm(spark, d):
    return _vector(spark, d, lambda s: V.rhythm(F.col("notes")))


def assembled_sizes(spark, d):
    s = V.assembled(segments(spark, d))
    return s.groupBy(F.size("melody").alias("melody"), F.size("rhythm").alias("rhythm"), F.size("combined").alias("combined")).agg(F.count(F.lit(1)).alias("n"))


def tokenize(spark, d):
    s = segments(spark, d)
    t = V.tokens(F.col("notes"))
    return s.select("score_id", "segment", F.array_join(F.transform(t, lambda x: F.array_join(x.cast("array<string>"), ".")), " ").alias("tokens"))


def standardize(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 8).cast("array<double>").alias("v"))
    return V.standardized(e, "vec_id", "v").select("vec_id", F.col("at").alias("component"), _r("z", "z"))


QUERIES = {f.__name__: f for f in (
    notes_derive, gap_segments, local_median, measure_length, candidate_times, boundary_evidence, cue_frequency, key_estimate, skyline, merged_ties, line_policy,
    render_events, roll_extent, extraction_summary, histogram_bars, interval_features, pitch_class_profile, shape_features, contour, rhythm, assembled_sizes, tokenize, standardize,
)}

_EV = f"""{_N}, w as (select *, list_sort(list_filter(list(d) over ({_W} rows between 3 preceding and 3 following), lambda x: x > 0)) as near from n),
m as (select *, coalesce(near[len(near) // 2 + 1], d) as med from w),
l as (select *, lag(p) over ({_W}) as p1, lag(p, 2) over ({_W}) as p2, lag(d) over ({_W}) as d1, lag(o) over ({_W}) as o1, lag(measure) over ({_W}) as m1, lag(med) over ({_W}) as l1, lead(p) over ({_W}) as pn from m),
c as (select score_id, o, case when o - (o1 + d1) < 0.25 then 0.0::double when o - (o1 + d1) < 0.5 then 0.3::double when o - (o1 + d1) < 1 then 0.6::double else 1.0::double end as rest_before,
  case when d1 >= 1.5::double * l1 then least(1.0::double, d1 / greatest(l1, 1e-6::double) - 1) else 0.0::double end as agogic_before,
  case when measure > m1 then 0.5::double else 0.0::double end as metric_strength, least(1.0::double, greatest(0.0::double, (abs(p - p1) - 2) / 10.0::double)) as leap_after,
  case when sign(p1 - p2) <> 0 and sign(pn - p) <> 0 and sign(p1 - p2) <> sign(pn - p) then 1.0::double else 0.0::double end as contour_change,
  case when (p1 % 12 in (2, 11, 7) and p % 12 = 0) or (p1 % 12 = 5 and p % 12 = 4) then 1.0::double when p % 12 = 0 then 0.5::double when p % 12 = 7 then 0.3::double else 0.0::double end as cadence
  from l where o1 is not null)"""
_JOIN = "array_to_string(list_transform({v}, lambda x: printf('%.4f', round(x::double, 4) + 0.0::double)), ',')"
_TURN = "case when len(iv) > 1 then list_avg(list_transform(range(1, len(iv)), lambda i: case when sign(iv[i]) <> sign(iv[i + 1]) then 1.0::double else 0.0::double end)) else 0.0::double end"
_ABS = "list_transform(iv, lambda x: abs(x)::double)"

ORACLE = {
    "notes_derive": f"with {_N} select score_id, part, p, round(o, 6) as o, round(d, 6) as d, measure from n",
    "gap_segments": f"""with {_SEG}, g2 as (select score_id, segment, min(o) as a, max(o + d) as b, count(*)::int as n from s group by all)
      select score_id, segment, round(a, 6) as start_q, round(b, 6) as end_q, n as n_notes, substr(sha1(printf('%d|part|0|%.6f|%.6f', score_id, round(a, 6), round(b, 6))), 1, 16) as segment_id from g2""",
    "local_median": f"with {_EV} select score_id, round(o, 6) as o, round(med, 6) as local_median from m",
    "measure_length": f"""with {_N}, l as (select score_id, o, d, p, lead(measure) over ({_W}) - measure as dm, lead(o) over ({_W}) - o as dq from n),
      g as (select score_id, list_sort(list(dq / dm) filter (where dm > 0 and dq > 0)) as l, count(*) as n, max_by(o + d, o) - min(o) as span from l group by 1)
      select score_id, round(case when len(l) > 0 then l[len(l) // 2 + 1] when n < 2 then 4.0::double else greatest(1.0::double, span / 4) end, 6) as measure_length from g""",
    "candidate_times": f"""with {_N}, t as (select score_id, round(o, 6) as t from n union select score_id, max_by(o + d, o) from n group by 1 union select score_id, 0.0::double from n)
      select score_id, count(*) as n, round(max(t), 6) as last from t group by 1""",
    "boundary_evidence": f"""with {_EV} select score_id, round(o, 6) as o, round(rest_before, 6) as rest_before, round(agogic_before, 6) as agogic_before, round(metric_strength, 6) as metric_strength,
      round(leap_after, 6) as leap_after, round(contour_change, 6) as contour_change, round(cadence, 6) as cadence,
      round(2.5::double * rest_before + 1.2::double * agogic_before + 0.7::double * metric_strength + 0.5::double * leap_after + 0.4::double * contour_change + cadence, 6) as evidence from c""",
    "cue_frequency": f"""with {_EV} select cue, count(*) as n from (unpivot (select rest_before, agogic_before, metric_strength, leap_after, contour_change, cadence from c)
      on rest_before, agogic_before, metric_strength, leap_after, contour_change, cadence into name cue value v) where v <> 0 group by 1""",
    "key_estimate": f"""with {_N}, f as (select score_id, p % 12 as pc from (select *, row_number() over ({_W}) as k from n) where k <= 64),
      profile(mode, v) as (values ('major', {N.MAJOR}::double[]), ('minor', {N.MINOR}::double[])),
      z as (select mode, list_transform(v, lambda x: (x - list_avg(v)) / sqrt(list_sum(list_transform(v, lambda y: (y - list_avg(v)) * (y - list_avg(v)))))) as z from profile),
      fit as (select score_id, mode, tonic, round(sum(z[(pc - tonic + 12) % 12 + 1]), 9) as fit from f, z, range(12) t(tonic) group by all),
      r as (select *, row_number() over (partition by score_id order by fit desc, tonic, mode desc) as k from fit)
      select score_id, tonic::int as tonic, mode from r where k = 1""",
    "skyline": f"""with {_N}, t as (select score_id, floor(o) as o, max((p // 12) * 12)::int as p, max(d) as d from n group by 1, 2),
      a as (select *, sum(case when p = pp then 0 else 1 end) over (partition by score_id order by o rows between unbounded preceding and current row) as r
        from (select *, lag(p) over (partition by score_id order by o) as pp from t)),
      b as (select *, max(o + d) over (partition by score_id, r order by o rows between unbounded preceding and 1 preceding) as pe from a),
      c as (select *, sum(case when o > pe + 1e-6::double then 1 else 0 end) over (partition by score_id, r order by o rows between unbounded preceding and current row) as g from b)
      select score_id, min(p) as p, round(min(o), 6) as o, round(max(o + d) - min(o), 6) as d from c group by score_id, r, g""",
    "merged_ties": f"""with {_N}, w as (select score_id, o, d, case when measure % 2 = 0 and o <= lag(o + d) over (partition by score_id order by o, d) + 1e-6::double then 0 else 1 end as new from n),
      i as (select *, sum(new) over (partition by score_id order by o, d rows between unbounded preceding and current row) as i from w)
      select score_id, 60 as p, round(min(o), 6) as o, round(max_by(o + d, o) - min(o), 6) as d from i group by score_id, i""",
    "line_policy": f"""with {_N}, h as (select * from n where part <> 'logout'),
      ev as (select score_id, part as line_id, o, p, d from h where part in ('click', 'view')),
      ok as (select score_id, line_id from ev group by all having count(*) >= 12), ex as (select ev.* from ev join ok using (score_id, line_id)),
      rest as (select * from h where score_id not in (select score_id from ok)),
      a as (select *, sum(case when p = pp then 0 else 1 end) over (partition by score_id order by o rows between unbounded preceding and current row) as r
        from (select *, lag(p) over (partition by score_id order by o) as pp from rest)),
      b as (select *, max(o + d) over (partition by score_id, r order by o rows between unbounded preceding and 1 preceding) as pe from a),
      c as (select *, sum(case when o > pe + 1e-6::double then 1 else 0 end) over (partition by score_id, r order by o rows between unbounded preceding and current row) as g from b),
      sk as (select score_id, min(o) as o, max(o + d) - min(o) as d from c group by score_id, r, g), sk2 as (select * from sk where score_id in (select score_id from sk group by 1 having count(*) >= 12))
      select 'explicit_voice' as extraction_mode, line_id, count(*) as notes, count(distinct score_id) as scores, round(sum(d), 4) as length from ex group by line_id
      union all select 'skyline', 'skyline', count(*), count(distinct score_id), round(sum(d), 4) from sk2 having count(*) > 0""",
    "render_events": f"with {_N} select score_id, p, round_even(o * 480, 0)::bigint as tick, 1 as note_on from n union all select score_id, p, round_even((o + d) * 480, 0)::bigint, 0 from n",
    "roll_extent": f"with {_N} select score_id, min(p) - 2 as low, max(p) + 2 as high, round(max(o + d), 6) as end_q from n group by 1",
    "extraction_summary": f"""with {_PH} select (select count(*) from q) as segments, (select count(distinct score_id) from q) as scores, (select round(median(bars), 6) from q) as median_bars,
      (select round(avg((len(ps) >= 8)::int), 6) from q) as long_share, (select median(k)::double from (select count(*) as k from q group by score_id)) as median_per_score""",
    "histogram_bars": f"""with {_PH}, b as (select min(bars) as lo, max(bars) as hi from q)
      select least(19, floor((bars - lo) / (hi - lo) * 20))::int as bin, count(*) as n from q, b group by 1""",
    "interval_features": f"""with {_PH} select score_id, segment, {_JOIN.format(v=f'''list_transform(range(25), lambda b: len(list_filter(iv, lambda x: least(greatest(x, -12), 12) + 12 = b)) / len(iv)::double) ||
      [list_avg({_ABS}), list_max({_ABS}), list_avg(list_transform(iv, lambda x: case when abs(x) <= 2 then 1.0::double else 0.0::double end)), {_TURN}, len(iv)::double]''')} as vector from q""",
    "pitch_class_profile": f"""with {_PH} select score_id, segment, {_JOIN.format(v='''list_transform(range(12), lambda b: coalesce(list_sum(list_transform(range(1, len(ps) + 1), lambda i: case when ((ps[i] - ps[1]) % 12 + 12) % 12 = b then ds[i] else 0.0::double end)), 0) / greatest(list_sum(ds), 1e-6::double))''')} as vector from q""",
    "shape_features": f"""with {_PH} select score_id, segment, {_JOIN.format(v=f'''[ln(1 + len(ps)), (list_max(ps) - list_min(ps))::double, list_avg({_ABS}), {_TURN}, greatest(0.0::double, 1 - list_sum(ds) / greatest(1e-6::double, dur)), bars, ds[len(ds)] / greatest(1e-6::double, ds[1])]''')} as vector from q""",
    "contour": f"""with {_PH}, g1 as (select *, list_transform(range(32), lambda i: i * greatest(dur, 1e-6::double) / 31.0::double) as ts from q),
      k as (select *, list_transform(ts, lambda t: len(list_filter(os, lambda o: o <= t))) as ks from g1)
      select score_id, segment, {_JOIN.format(v='''list_transform(range(1, 33), lambda i: case when ks[i] = 0 then 0.0::double when ks[i] = len(ps) then ps[len(ps)] - ps[1]
        else ps[ks[i]] + (ps[ks[i] + 1] - ps[ks[i]]) * (ts[i] - os[ks[i]]) / (os[ks[i] + 1] - os[ks[i]]) - ps[1] end)''')} as vector from k""",
    "rhythm": f"""with {_PH}, f as (select *, greatest(dur, 1e-6::double) as e, list_transform(range(1, len(os)), lambda i: os[i + 1] - os[i]) as st from q),
      g1 as (select *, list_transform(os, lambda o: least(31, floor(o / e * 31.0::double)::int)) as ob, list_transform(os, lambda o: floor(o / e * 31.0::double)) as lo,
        list_transform(range(1, len(os) + 1), lambda i: ceil((os[i] + ds[i]) / e * 31.0::double)) as hi, list_transform(st, lambda x: x / e) as ioi, list_transform(ds, lambda x: x / e) as du from f),
      h as (select *, list_transform(range(32), lambda b: len(list_filter(ob, lambda x: x = b)) / len(ps)::double) as onset,
        list_transform(range(32), lambda b: len(list_filter(range(1, len(os) + 1), lambda i: lo[i] <= b and hi[i] >= b))::double) as busy from g1)
      select score_id, segment, {_JOIN.format(v='''onset || list_transform(busy, lambda x: x / greatest(list_max(busy), 1)) || [list_avg(ioi), list_stddev_pop(ioi), list_avg(du), list_stddev_pop(du),
        greatest(0.0::double, 1 - list_sum(du) / e), len(ps) / e, case when len(ps) > 2 then list_avg(list_transform(st, lambda x: abs(x))) else 0.0::double end, list_avg(list_transform(onset, lambda x: case when x > 0 then 1.0::double else 0.0::double end))]''')} as vector from h""",
    "assembled_sizes": f"with {_PH} select 74 as melody, 72 as rhythm, 153 as combined, count(*) as n from q",
    "tokenize": f"""with {_PH} select score_id, segment, case when len(ps) <= 96 then array_to_string(list_transform(range(1, len(ps) + 1), lambda i:
      (case when ps[i] - ps[1] < -48 then 2 when ps[i] - ps[1] > 48 then 3 else ps[i] - ps[1] + 52 end) || '.' ||
      (case when i = 1 then 28 when ps[i] - ps[i - 1] < -24 then 2 when ps[i] - ps[i - 1] > 24 then 3 else ps[i] - ps[i - 1] + 28 end) || '.' ||
      (round_even(least(greatest((os[i] - os[1]) / dur, 0), 1) * 127, 0)::int + 2) || '.' || (round_even(least(greatest(ds[i] / dur, 0), 1) * 63, 0)::int + 2) || '.' ||
      (case when i = 1 then 2 else round_even(least(greatest((os[i] - os[i - 1]) / dur, 0), 1) * 63, 0)::int + 2 end)), ' ') end as tokens from q""",
    "standardize": """with x as (select vec_id, unnest(range(8)) as c, unnest(embedding[1:8])::double as x from embeddings), f as (select c, avg(x) as m, stddev_pop(x) as s from x group by 1)
      select vec_id, c::int as component, round((x - m) / case when s > 1e-12 then s else 1 end, 6) as z from x join f using (c)""",
}
