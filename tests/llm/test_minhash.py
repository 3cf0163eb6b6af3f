"""MinHash near-duplicates against brute force, and their edge cases."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from lineweave.llm import minhash
from lineweave.llm.words import shingle_set, words

_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, width, percent):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(_LOW))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = [i for i, _ in rows]
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_same_as_brute_force(spark, width, percent):
    rng = random.Random(width)
    rows = []
    for group in range(12):
        base = " ".join(rng.choice("abcdefghijklmnop") + str(rng.randrange(40)) for _ in range(rng.randrange(5, 200)))
        rows += [(len(rows) + k, edited(rng, base, rng.randrange(0, 8))) for k in range(rng.randrange(1, 14))]
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "One two"), (904, "one TWO"), (905, "ONE"), (906, "é É"), (907, "one\x0btwo")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=width, percent=percent).collect()
    want = brute(rows, width, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_chain_and_large_group(spark):
    """Texts that drift apart step by step form one component; so do many copies."""
    rng = random.Random(3)
    text, rows = " ".join(f"w{k}" for k in range(150)), []
    for k in range(30):
        rows.append((k, text))
        text = edited(rng, text, 1)
    rows += [(1000 + k, "the same short text again") for k in range(400)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows[:30] + rows[30:32], 3, 85)
    assert all(got[i] == want[i][1] for i in range(30))
    assert {got[1000 + k] for k in range(400)} == {1000}


def test_null_ids_repeated_rows_clashing_columns_and_no_rows(spark):
    rows = [(1, "a b c d", "x"), (1, "a b c d", "y"), (None, "a b c d", "z"), (2, "a b c d", None), (3, None, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, bucket string").selectExpr("doc_id", "text", "bucket", "1 as item", "2 as component_id", "bucket as digest")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect())
    assert got == [(False, 1, 1, True), (False, 1, 1, True), (False, 2, 1, False), (False, 3, 3, True), (True, 0, None, True)]
    assert minhash.near_duplicates(df.limit(0)).collect() == []


def test_signature_is_circulant_and_sketch_is_a_bound():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
    b = np.unique(np.concatenate([a[:350], rng.integers(0, 2**63, 60).astype(np.uint64)]))
    agree = np.mean(minhash.signature(a, 512) == minhash.signature(b, 512))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(agree - true) < 0.1
    differ = sum(bin(int(x) & (2**64 - 1)).count("1") for x in minhash.odd_sketch(a) ^ minhash.odd_sketch(b))
    assert differ <= len(np.setxor1d(a, b))


def test_very_long_text(spark):
    text = " ".join(f"w{k % 977}x{k % 31}" for k in range(200_000))
    rows = [(1, text), (2, text + " tail"), (3, "x" * 1_000_000)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_words_follow_the_pattern():
    text = "Ab c  D\x1fe\nÉF\x0c g"
    data = np.frombuffer(text.encode(), np.uint8)
    h, starts, ends, first = words(data, np.array([0, len(data)]))
    assert [bytes(data[s:e]).decode() for s, e in zip(starts, ends, strict=True)] == re.findall(r"[^\x20\x09-\x0d]+", text)
    assert first.tolist() == [0, len(h)]
    assert len(shingle_set(h[:0], 3)) == 0


def test_texts_of_one_id_are_told_apart(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    near = " ".join([*(f"a{k}" for k in range(29)), "other"])
    rows = [(1, a, "p"), (2, near, "q"), (2, b, "r"), (2, b, "r"), (3, b, "s"), (4, None, "t"), (None, a, "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, mark string").selectExpr("doc_id", "text", "mark", "1 as id", "2 as component")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in minhash.near_duplicates(df, width=3, percent=80).collect())
    assert got == [(0, 0, True), (1, 1, True), (2, 1, False), (2, 2, True), (2, 2, True), (3, 2, False), (4, 4, True)]
    kept = minhash.without_duplicates(df, width=3, percent=80)
    assert kept.columns == df.columns and sorted(r.mark for r in kept.collect()) == ["p", "r", "r", "t", "u"]
    assert minhash.without_duplicates(df.limit(0)).collect() == []
    with pytest.raises(TypeError, match="whole numbers"):
        minhash.near_duplicates(df.withColumn("doc_id", df.mark))
