"""The pipeline's stages against what each must have done to its own input."""

from __future__ import annotations

import random
import re

import numpy as np
import public_tokenizers
import tokenizers

import corpus_pipeline
from lineweave.llm import langid

_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(_LOW))


def test_stages(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    clean = docs.collect()
    rng = random.Random(2)
    extra = [(10_000, clean[0].text, clean[0].lang, "x", 1), (10_001, " ".join([*tokens(clean[1].text)[:-1], "changed"]), clean[1].lang, None, None), (10_002, None, None, None, None), (10_003, "12 34 !!", "en", None, 8)]
    passage = " ".join(f"the{rng.randrange(10**6)}" for _ in range(60))
    extra += [(10_010 + k, f"{clean[20 + k].text} {passage}", clean[20 + k].lang, "y", 2) for k in range(3)]
    own = docs.where("doc_id not in (20, 21, 22)").unionByName(spark.createDataFrame(extra, docs.schema))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "MinHash near-dedup", "substring dedup", "packing"]
    stages = dict(corpus_pipeline.STAGES)

    first = stages["language ID"](spark, own, "").collect()
    model = langid.train(own, "lang", "text", "doc_id")
    rejected = {r.doc_id for r in langid.predict(own, model).collect() if r.rejected}
    assert {r.doc_id for r in first} == {r.doc_id for r in own.collect()} - rejected and rejected == {10_002, 10_003}

    kept = spark.createDataFrame(first, docs.schema)
    second = stages["MinHash near-dedup"](spark, kept, "").collect()
    sets = {r.doc_id: frozenset(zip(*[tokens(r.text)[k:] for k in range(5)], strict=False)) or frozenset([tuple(tokens(r.text))]) for r in first}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {r.doc_id for r in second} == {i for i in ids if find(i) == i}

    third = stages["substring dedup"](spark, spark.createDataFrame(second, docs.schema), "").collect()
    assert {r.doc_id for r in third} == {r.doc_id for r in second}
    hold = [r.doc_id for r in third if passage in " ".join(tokens(r.text))]
    assert len(hold) == 1 and hold[0] == min(r.doc_id for r in second if passage in r.text)
    assert all(tokens(a.text) == tokens(b.text) or len(a.text) < len(b.text) for a, b in zip(sorted(third), sorted(second), strict=True))

    last = stages["packing"](spark, spark.createDataFrame(third, docs.schema), "").collect()
    lib = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    size = {r.doc_id: len(lib.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in third}
    got = {i: sum(r.length for r in last if r.doc_id == i) for i in size}
    assert got == size and np.max([r.offset + r.length for r in last]) <= 2048


def test_run_is_the_stages_one_after_another(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, docs.collect()))


def test_odd_input(spark):
    """Null ids and texts, rows that repeat an id, very long texts, columns whose names the operators use, no rows."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang = 'en'").limit(30)
    rng = random.Random(5)
    known = sorted({w for r in docs.collect() for w in tokens(r.text)})
    text = lambda n: " ".join(f"{rng.choice(known)} {rng.choice(known)}{rng.randrange(10**4)}" for _ in range(n // 2))
    long, same, other, none_ = text(40_000), text(200), text(200), text(200)
    extra = [(20_000, long), (20_001, f"{long} more"), (20_002, same), (20_002, other), (20_003, same), (None, none_), (None, None), (20_004, "")]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in extra]
    own = docs.unionByName(spark.createDataFrame(rows, docs.schema)).selectExpr("*", "lang as label", "substr(text, 1, 40) as id", "doc_id as component", "1 as spans", "source as mark")
    at = own
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = spark.createDataFrame(stage(spark, at, "").collect(), own.schema)
        assert at.columns == own.columns, name
        left = {(r.doc_id, (r.id or "")) for r in at.collect()}
        assert {(20_000, long[:40]), (20_002, same[:40]), (20_002, other[:40]), (None, none_[:40])} <= left, name
        assert ((20_001, long[:40]) in left) == ((20_003, same[:40]) in left) == (name == "language ID")
        assert (20_004, "") not in left and (None, "") not in left
    packed = corpus_pipeline.STAGES[-1][1](spark, at, "").collect()
    assert sum(r.doc_id == 20_000 for r in packed) >= 20 and any(r.doc_id is None for r in packed)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, own.limit(0), "").collect() == [], name
