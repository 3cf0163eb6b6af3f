"""Class n-grams: exact counts and base scores, better than the base on held-out texts, proper probabilities."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lineweave.llm import brown
from lineweave.llm.words import words

_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(_LOW)), "\n"]


def check(rows, got):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    count = Counter(w for i, t in rows if not held[i] for w in tokens(t))
    n, v = sum(count.values()), len(count)
    assert len(got) == len(rows)
    for r in got:
        own = tokens(dict(rows)[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(own), sum(count[w] > 0 for w in own), n)
        want = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own)
        assert abs(r.base_score - want) <= 1e-9 * max(1, abs(want))
        assert r.score < 0 and math.isfinite(r.score)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = brown.score_held_out(docs).collect()
    check([(r.doc_id, r.text) for r in docs.collect()], got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def hashes(texts):
    data = np.frombuffer(" ".join(texts).encode(), np.uint8)
    return words(data, np.array([0, len(data)]))[0].view(np.int64).tolist()


def brute_scores(rows, model, rare, count):
    """Scores token by token from the model's tables; count: of training tokens."""
    kinds = dict(zip(model.vocab.word.tolist(), model.kind[:-1].tolist(), strict=True)) | rare
    names = sorted({w for _, t in rows for w in tokens(t)} - {"\n"})
    of = dict(zip(names, hashes(names), strict=True)) | {"\n": int(brown.END)}
    size, out = Counter(), []
    for w, n in count.items():
        size[kinds.get(of[w], brown.TAIL) if w in of else brown.TAIL] += n
    tail_v = sum(kinds.get(of.get(w), brown.TAIL) == brown.TAIL for w in count)
    for _, t in rows:
        total, last = 0.0, brown.STOP
        for w in tokens(t):
            k = kinds.get(of[w], brown.TAIL)
            p = (count[w] + 1) / (size[k] + tail_v + 1) if k == brown.TAIL else max(count[w], 1) / max(size[k], 1)
            total, last = total + model.transition[last, k] + math.log10(p), k
        out.append(total)
    return out


@pytest.mark.parametrize("lookup", [1 << 18, 300])
def test_scores_against_the_tables(spark, monkeypatch, lookup):
    """With a small lookup most words have distributed classes and go through joins."""
    monkeypatch.setattr(brown, "LOOKUP", lookup)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check(rows, brown.score_held_out(docs).collect())
    counts = brown.word_counts(docs, "text").cache()
    model, rare = brown.fit(docs, "text", counts)
    of = {} if rare is None else {r.word: r.kind for r in rare.collect()}
    assert (lookup == 300) == bool(of)
    count = Counter(w for _, t in rows for w in tokens(t))
    assert len(of) + len(model.vocab.word) == sum(n > 1 for n in count.values())
    got = {r.doc_id: r.score for r in brown.score(docs, model, rare, counts).collect()}
    for (i, _), want in zip(rows, brute_scores(rows, model, of, count), strict=True):
        assert got[i] == pytest.approx(want, rel=1e-9)
    assert np.allclose((10**model.transition).sum(1), 1)


def test_gains_are_those_of_the_likelihood():
    rng = np.random.default_rng(2)
    text = rng.integers(0, 30, 2000)
    kind = np.concatenate([rng.integers(0, 8, 29), [9]])

    def table(kind):
        out = np.zeros((brown.KINDS, brown.KINDS))
        np.add.at(out, (kind[text[:-1]], kind[text[1:]]), 1)
        return out

    model = brown.Exchange(table(kind))
    for word in rng.integers(0, 29, 200):
        after, before = text[1:][text[:-1] == word], text[:-1][text[1:] == word]
        own = (after == word).sum()
        right, left = (np.bincount(kind[x[x != word]], minlength=brown.KINDS).astype(float) for x in (after, before))
        a, b = kind[word], (kind[word] + rng.integers(1, 8)) % 8
        gain, old = model.gain(a, b, right, left, own), brown.likelihood(table(kind))
        kind[word] = b
        assert gain == pytest.approx(brown.likelihood(table(kind)) - old, abs=1e-6)
        model.move(a, b, right, left, own)
        assert np.allclose(model.table, table(kind)) and np.allclose(model.rows, table(kind).sum(1)) and np.allclose(model.columns, table(kind).sum(0))


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "A a b\x1fc"), (4, "word " * 30000), (5, "É é"), (6, "a a a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as word", "2 as n", "3 as row")
    check(rows, brown.score_held_out(df).collect())
    assert brown.score_held_out(df.limit(0)).collect() == []
    alone = brown.score_held_out(df.where("crc32(cast(cast(doc_id as string) as binary)) % 7 = 2")).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in alone)
    got = brown.score_held_out(df.union(df.where("doc_id = 6"))).collect()
    assert sum(r.doc_id == 6 for r in got) == 2
    nulls = brown.score_held_out(df.selectExpr("cast(null as long) as doc_id", "text")).collect()
    assert all(not r.held_out and r.train_tokens == 0 for r in nulls)


def test_emissions_are_probabilities(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    m, _ = brown.fit(docs, "text", brown.word_counts(docs, "text").cache())
    assert np.allclose((10**m.transition).sum(1), 1)
    total = np.bincount(m.kind[:-1], 10 ** m.emission[:-1], minlength=brown.KINDS)
    assert np.all((np.abs(total - 1) < 1e-9) | (total == 0))


def test_exchange_finds_classes(spark, monkeypatch):
    """Words of two kinds that alternate end up in classes by kind, looked up or not."""
    rng = np.random.default_rng(1)
    left, right = [f"l{k}" for k in range(20)], [f"r{k}" for k in range(20)]
    texts = [" ".join(x for _ in range(200) for x in (rng.choice(left), rng.choice(right))) for _ in range(20)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    counts = brown.word_counts(docs, "text").cache()
    for lookup in (1 << 18, 25):
        monkeypatch.setattr(brown, "LOOKUP", lookup)
        m, rare = brown.fit(docs, "text", counts)
        at = dict(zip(m.vocab.word.tolist(), m.kind.tolist(), strict=False)) | ({r.word: r.kind for r in rare.collect()} if rare else {})
        kinds = [{at[x] for x in hashes(group)} for group in (left, right)]
        assert not kinds[0] & kinds[1]


def corpus(spark, n=60):
    """Texts of two kinds of words in turn, frequent ones far more often than others."""
    rng = np.random.default_rng(3)
    pick = lambda c: f"{c}{int(rng.pareto(0.9) * 4) % 150}"
    return spark.createDataFrame([(k, " ".join(pick("ab"[i % 2]) if rng.random() < 0.9 else pick("c") for i in range(80))) for k in range(n)], "doc_id long, text string")


def test_slices_follow_every_move(spark):
    """Moves within a slice of the real size leave exact tables, and a likelihood like that of words one by one."""
    docs = corpus(spark)
    vocab = brown.vocabulary(brown.word_counts(docs, "text"))
    near = brown.contexts(docs, "text", vocab).cache()
    rows = near.orderBy("unit").toArrow().combine_chunks().to_batches()[0]
    found = {}
    for size in (1, brown.SLICE):
        kind = vocab.first_kinds()
        model = brown.Exchange(brown._table(near, kind))
        for _ in range(4):
            for lo in range(0, len(rows), size):
                some = rows.slice(lo, size)
                unit = some.column(0).to_numpy()
                brown.move_words(model, kind, unit, some.column(1).to_numpy(), *some.columns[2:], np.ones(len(unit), bool))
                assert model.table.min() >= 0
        assert np.allclose(model.table, brown._table(near, kind)) and np.allclose(model.rows, model.table.sum(1)) and np.allclose(model.columns, model.table.sum(0))
        assert np.allclose(model.terms, brown._xlogx(model.table)) and np.allclose(model.logs, np.log(model.table + brown.SOFT))
        found[size] = brown.likelihood(model.table)
    start = brown.likelihood(brown._table(near, vocab.first_kinds()))
    assert found[1] == found[brown.SLICE] > start
    assert brown.likelihood(brown.exchange(near, vocab.first_kinds())[1]) - start > 0.8 * (found[1] - start)


def test_classes_do_not_depend_on_partitions(spark):
    docs = corpus(spark)
    made = []
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        for parts, batch in ((2, 10_000), (7, 3)):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            some = docs.repartition(parts)
            made.append(brown.fit(some, "text", brown.word_counts(some, "text").cache())[0])
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert (made[0].kind == made[1].kind).all() and np.allclose(made[0].transition, made[1].transition)
