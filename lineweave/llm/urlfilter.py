"""URL filtering by host and path rules, then by logistic regression on hashed character n-grams.

Everything here is DataFrame and SQL expressions. The labelled table is small by contract (MOST_LABELLED rows at
most), so training is done on its Gram matrix: the dual of gradient descent on the weights, folded over the epochs
inside one row. The weights of the n-gram buckets, DIMS numbers, then become a literal of the scoring projection,
which needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIMS = 4096
EPOCHS, RATE, DECAY = 400, 0.05, 0.001
MOST_LABELLED = 1000

#: (verdict, host, path): a rule fits its host and all subdomains if the path starts with the rule's.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

# The labelled URLs that the production model is trained on (1: block).
LABELLED = [
    (1, "http://www.cheap-pills.example.com/en/12"),
    (1, "https://cheap-pills-online.example.org/buy/now"),
    (1, "https://blog.discount-pharmacy.example.com/pills/33?ref=x"),
    (1, "http://casino-win.example.com/en/7"),
    (1, "https://m.royal-casino.example.org/bonus/1"),
    (1, "https://www.win-big-casino.example.com/es/81#top"),
    (1, "http://free-bets.example.org/fr/40"),
    (1, "https://sports-bets.example.com/free/2"),
    (1, "https://blog.free-bets-daily.example.com/en/5.html"),
    (1, "http://adult-x.example.com/en/14"),
    (1, "https://www.adult-x-videos.example.org/de/9"),
    (1, "https://m.xxx-adult.example.com/cams/3"),
    (1, "http://spam-farm.example.org/en/21"),
    (1, "https://blog.link-farm.example.com/spam/8?page=2"),
    (1, "https://seo-spam.example.org/en/99/"),
    (1, "http://ads-track.example.com/en/6?utm_source=feed"),
    (1, "https://m.click-ads.example.org/track/44"),
    (1, "https://www.pixel-track.example.com/ads/1"),
    (1, "http://payday-loans-fast.example.com/apply"),
    (1, "https://crypto-double.example.org/win/free"),
    (0, "https://www.theron.example.com/en/12"),
    (0, "http://thering.example.org/en/345.html"),
    (0, "https://blog.tionble.example.com/fr/7020.html"),
    (0, "https://m.tiontion.example.com/es/37033?utm_source=feed"),
    (0, "http://ththan.example.org/de/27099"),
    (0, "https://www.library.example.org/catalog/books/12"),
    (0, "https://news.example.com/en/2024/05/world"),
    (0, "https://docs.example.org/en/guide/install"),
    (0, "http://www.university.example.com/research/paper/8"),
    (0, "https://blog.cooking.example.com/recipes/33"),
    (0, "https://www.museum.example.org/fr/visit"),
    (0, "https://forum.gardening.example.com/es/thread/71"),
    (0, "http://m.weather.example.com/en/today"),
    (0, "https://wiki.history.example.org/de/article/5"),
    (0, "https://www.travel-notes.example.com/en/lisbon/3"),
    (0, "http://blog.open-source.example.org/en/release/2"),
    (0, "https://science-daily.example.com/physics/55#top"),
    (0, "https://www.music-school.example.org/es/courses"),
    (0, "https://therer.example.com/en/1182/"),
    (0, "http://blog.ththor.example.com/en/7?page=2&ref=x"),
]


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _tagged(kind: str, grams: Column) -> Column:
    return F.transform(grams, lambda g: F.concat(F.lit(kind), g))


def _buckets(host: Column, path: Column) -> Column:
    """Distinct buckets of the 3- and 4-grams of ^host$ and of the path with digits as 0."""
    marked = [("h", F.concat(F.lit("^"), host, F.lit("$"))), ("p", F.regexp_replace(path, "[0-9]", "0"))]
    grams = [_tagged(kind, F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), 1)) for kind, text in marked for n in (3, 4)]
    return F.array_distinct(F.transform(F.concat(*grams), lambda g: F.conv(F.substring(F.md5(g), 1, 8), 16, 10).cast("long") % DIMS))


def labelled_table(spark: SparkSession, rows: list[tuple[int, str]]) -> DataFrame:
    values = ", ".join(f"({i}, {y}, '{url}')" for i, (y, url) in enumerate(rows))
    return spark.sql(f"select * from values {values} as t(i, y, url)")


def train(labelled: DataFrame, epochs: int = EPOCHS, rate: float = RATE, decay: float = DECAY) -> list[float]:
    """Weights of the DIMS buckets, then the bias. labelled: i (0, 1, ..., without gaps), y (0 or 1) and url."""
    rows = labelled.select("i", F.col("y").cast("double").alias("y"), _buckets(host_of(F.col("url")), path_of(F.col("url"))).alias("b"))
    seen = rows.agg(F.count("i"), F.max("i")).first()
    if not seen[0] or seen[0] > MOST_LABELLED or seen[1] != seen[0] - 1:
        raise ValueError(f"the labelled table must have 1 to {MOST_LABELLED} rows, numbered from 0")
    grams = rows.select("i", F.explode("b").alias("b"), (1 / F.sqrt(F.size("b").cast("double"))).alias("x"))
    shared = grams.alias("p").join(grams.alias("q"), F.col("p.b") == F.col("q.b")).groupBy(F.col("p.i").alias("i"), F.col("q.i").alias("j")).agg(F.sum(F.col("p.x") * F.col("q.x")).alias("k"))
    entries = shared.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", "k"))).alias("k"))
    gram = rows.select("i", "y").join(entries, "i", "left")
    gram = gram.select("i", "y", F.expr(f"transform(sequence(0, {seen[0] - 1}), j -> coalesce(k[j], 0D) + 1D)").alias("row"))
    one = gram.agg(F.array_sort(F.collect_list(F.struct("i", "y", "row"))).alias("g"))
    step = f"""aggregate(sequence(1, {epochs}), array_repeat(0D, size(g)), (a, t) -> transform(g, (r, i) ->
        a[i] + {rate}D * (r.y - 1D / (1D + exp(-aggregate(zip_with(r.row, a, (p, q) -> p * q), 0D, (s, v) -> s + v)))) - {rate * decay}D * a[i]))"""
    alpha = one.select(F.posexplode(F.expr(step)).alias("i", "alpha"))
    weights = grams.join(alpha, "i").groupBy("b").agg(F.sum(F.col("alpha") * F.col("x")).alias("w"))
    out = [0.0] * (DIMS + 1)
    for r in weights.unionByName(alpha.agg(F.lit(DIMS).cast("long").alias("b"), F.sum("alpha").alias("w"))).collect():  # DIMS + 1 rows at most
        out[r["b"]] = float(r["w"])
    return out


def judge(pages: DataFrame, weights: list[float], rules: list[tuple[str, str, str]], key: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, by_model (the model's own opinion, block or allow).

    The longest rule that fits decides; else the model blocks above probability 1/2. A null or empty url and one
    without :// have an empty host and path, fit no rule, and are judged by the model like any other. Only the two
    named columns are read; repeated rows each get a row; an empty table gives none.
    """
    w = F.lit([float(x) for x in weights])
    parts = pages.select(F.col(key).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    ranked = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    rule = verdict = None
    for action, host, path in ranked:
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, host + path) if rule is None else rule.when(fits, host + path)
        verdict = F.when(fits, action) if verdict is None else verdict.when(fits, action)
    b = parts.withColumn("b", _buckets(F.col("host"), F.col("path")))
    z = F.aggregate("b", F.lit(0.0), lambda s, k: s + F.get(w, k.cast("int"))) / F.sqrt(F.greatest(F.size("b"), F.lit(1)).cast("double")) + weights[DIMS]
    model = F.when(z > 0, "block").otherwise("allow")
    none = F.lit(None).cast("string")
    scored = b.select("page_id", "host", "path", (rule if rule is not None else none).alias("rule"), (verdict if verdict is not None else none).alias("ruled"), model.alias("by_model"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", "by_model").alias("verdict"), "by_model")


def oracle() -> str:
    """The production query in DuckDB: the same training, folded over a recursive table, and scoring."""
    values = ", ".join(f"({i}, {y}::double, '{url}')" for i, (y, url) in enumerate(LABELLED))
    case = " ".join(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then ('{h}{p}', '{a}')" for a, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])))
    parts = r"""case when contains(coalesce(url, ''), '://') then
        translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
        case when contains(coalesce(url, ''), '://') then regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) else '' end as path"""
    grams = " || ".join(f"list_transform(range(1, len({t}) - {n - 2}), lambda i: '{k}' || substr({t}, i, {n}))" for k, t in (("h", "('^' || host || '$')"), ("p", "regexp_replace(path, '[0-9]', '0', 'g')")) for n in (3, 4))
    buckets = f"list_distinct(list_transform({grams}, lambda g: ('0x' || substr(md5(g), 1, 8))::bigint % {DIMS}))"
    return f"""
with recursive labelled(i, y, url) as (values {values}),
lab as materialized (select i, y, {buckets} as b from (select i, y, {parts} from labelled)),
lg as materialized (select i, unnest(b) as b, 1 / sqrt(len(b)::double) as x from lab),
shared as (select p.i as i, q.i as j, sum(p.x * q.x) as k from lg p join lg q on p.b = q.b group by all),
gram as materialized (
  select a.i, any_value(a.y) as y, list(coalesce(s.k, 0) + 1 order by c.i) as r
  from lab a cross join lab c left join shared s on s.i = a.i and s.j = c.i group by a.i),
one as materialized (select list(y order by i) as y, list(r order by i) as g, list(0::double) as zero from gram),
gd(t, a) as (
  select 0, list_transform(y, lambda v: 0::double) from one
  union all
  select t + 1, list_transform(one.g, lambda r, i: a[i] + {RATE} * (one.y[i] - 1 / (1 + exp(-list_dot_product(r, a)))) - {RATE * DECAY} * a[i])
  from gd, one where t < {EPOCHS}),
fin as materialized (select a from gd where t = {EPOCHS}),
w as materialized (select lg.b, sum(fin.a[lg.i + 1] * lg.x) as w from lg, fin group by lg.b),
pg as materialized (select page_id, host, path, case {case} end as ruled, {buckets} as b from (select page_id, {parts} from pages)),
z as (select page_id, sum(w.w) as z from (select page_id, unnest(b) as b from pg) join w using (b) group by page_id),
v as (select pg.*, case when coalesce(z.z, 0) / sqrt(greatest(len(pg.b), 1)::double) + (select list_sum(a) from fin) > 0 then 'block' else 'allow' end as by_model
  from pg left join z using (page_id))
select page_id, host, path, ruled[1] as rule, coalesce(ruled[2], by_model) as verdict, by_model from v"""
