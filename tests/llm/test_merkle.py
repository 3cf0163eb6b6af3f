"""The manifest against a plain recursion, over all sizes around a block's edges and odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lineweave.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, tampered=False):
    doc_id, source, lang, n, text = row
    if tampered and text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
        text = text.replace("\n", "")
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n, text)])


def tree(nodes):
    """The root, and for each node the siblings left and right of it on every level."""
    paths, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(place):
            lo = p - p % 3
            paths[k].append(("".join(nodes[lo:p]), "".join(nodes[p + 1 : lo + 3])))
        place = [p // 3 for p in place]
        nodes = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs = {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        subs[s] = tree([leaf(r) for r in groups[s]])
    root, tops = tree([subs[s][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for r, path in zip(groups[s], subs[s][1], strict=True):
            path = path + tops[k]
            node = leaf(r, True)
            for a, b in path:
                node = h(a, node, b)
            out.append((r[0], leaf(r), subs[s][0], root, h(*[a + b for a, b in path]), node, node == root))
    return out


def same(spark, rows, parts=3):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    got = [tuple(r) for r in merkle.tamper_check(docs.withColumn("leaf", F.lit(1)).withColumn("path", F.lit(2))).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(got, key=key) == sorted(plain(rows), key=key)
    return got


@pytest.mark.parametrize("levels", [1, 2])
def test_blocks_of_few_levels(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 3**levels)
    rng = random.Random(levels)
    sizes = {None: 1, "": 2, "a": 3, "b": 4, "Z": 9, "ä": 10, "c": 28, "d": 31}
    rows = [(i, s, None, i * 7, f"t{i}\n" if i % 3 else None) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    rng.shuffle(rows)
    got = same(spark, rows)
    assert {r[6] for r in got} == {True, False}


def test_odd_rows(spark):
    same(spark, [(1, "s", "de", 3, "a\nb")])
    same(spark, [(4, None, None, None, None)])
    same(spark, [(7, "s", "en", 1, "x"), (7, "s", "en", 1, "x"), (7, "s", "en", 2, "y\n"), (None, "s", "en", 1, "ü\n"), (None, None, None, None, "")])
    same(spark, [(i, "one", "fr", 1, "long\n" * 100_000 if i == 2 else "") for i in range(-3, 8)])
    assert merkle.tamper_check(spark.createDataFrame([], SCHEMA)).collect() == []


def test_many_groups(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 3)
    same(spark, [(i, f"s{i % 23}", "en", i, "a\n") for i in range(60)])


def test_root_tells_any_change(spark):
    rows = [(i, "s" if i % 2 else "t", "en", i, f"text {i}\n") for i in range(50)]
    made = lambda x: merkle.proofs(spark.createDataFrame(x, SCHEMA), "doc_id", "source", merkle.FIELDS).select("root").first()[0]
    assert made(rows) == made(rows[::-1]) != made(rows[:-1]) and made(rows) != made(rows[:-1] + [(49, "s", "en", 49, "text 49")])
