"""URL filter: parsing, rules and the trained model against plain Python."""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from lineweave.llm import urlfilter as u


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return "".join(c.lower() if c.isascii() else c for c in host), path


def buckets(host, path):
    text = {"h": f"^{host}$", "p": re.sub("[0-9]", "0", path)}
    return sorted({int(hashlib.md5((k + t[i : i + n]).encode()).hexdigest()[:8], 16) % u.DIMS for k, t in text.items() for n in (3, 4) for i in range(len(t) - n + 1)})


def rule(host, path):
    fits = [(len(h + p), h + p, a) for a, h, p in u.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


ODD = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.NET/En/1", "http://a.example.net/en/", "http://net/x", "http://xnet/x", "http://net", "http://net?x=/", "http://x.org/fr/1#/de/", "a://b://c/d",
       "http://www.EXAMPLE.com/de/?q", "http://É.example.com/de/x", "http://u@h:80/p", "x\n://y.net/\nz?", "http://example.com/de", "ftp://sub.example.net/en/x", "http://casino-win.example.org/" + "a" * 200_000]


def test_against_plain_python(spark):
    weights = u.train(u.labelled_table(spark, u.LABELLED))
    x = np.zeros((len(u.LABELLED), u.DIMS))
    for i, (_, url) in enumerate(u.LABELLED):
        b = buckets(*parts(url))
        x[i, b] = 1 / np.sqrt(len(b))
    y, k, a = np.array([y for y, _ in u.LABELLED], float), x @ x.T + 1, np.zeros(len(x))
    for _ in range(u.EPOCHS):
        a = a + u.RATE * (y - 1 / (1 + np.exp(-k @ a))) - u.RATE * u.DECAY * a
    assert np.allclose(weights, [*(x.T @ a), a.sum()], atol=1e-9)
    rows = list(enumerate(ODD)) + [(4, ODD[4])]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("page_id", "url", "1 as host", "2 as b", "3 as rule")
    got = u.judge(df, weights, u.RULES).collect()
    assert len(got) == len(rows)
    w = np.array(weights)
    for r in got:
        host, path = parts(ODD[r.page_id])
        assert (r.host, r.path) == (host, path), ODD[r.page_id]
        b = buckets(host, path)
        model = "block" if w[b].sum() / np.sqrt(max(len(b), 1)) + w[-1] > 0 else "allow"
        name, verdict = rule(host, path)
        assert (r.rule, r.verdict, r.by_model) == (name, verdict or model, model)
    assert u.judge(df.limit(0), weights, u.RULES).collect() == []
    assert {r.rule for r in u.judge(df, weights, []).collect()} == {None}


def test_model_on_hosts_it_hasnt_seen(spark):
    weights = u.train(u.labelled_table(spark, u.LABELLED))
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    got = u.judge(pages, weights, []).withColumn("bad", F.col("host").rlike("pills|casino|bets|adult|spam|ads-track"))
    wrong = got.where(F.col("bad") != (F.col("verdict") == "block")).count()
    assert wrong <= 0.01 * pages.count()


def test_plan_is_native(spark):
    weights = u.train(u.labelled_table(spark, u.LABELLED))
    df = u.judge(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"), weights, u.RULES)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan) and "html" not in re.search(r"ReadSchema: \S+", plan).group()
