"""Packing: ids of the tokenizers library, whole coverage, capacity and little padding."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import tokenizers

from lineweave.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, got, length):
    lib = tokenizers.Tokenizer.from_file(PATH)
    ids = {i: np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in rows}
    at, room = defaultdict(int), defaultdict(int)
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        at[r.doc_id] += r.length
    assert dict(at) == {i: len(x) for i, x in ids.items()}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == room[r.sequence_id]
        room[r.sequence_id] += r.length
    assert max(room.values(), default=0) <= length
    return len(room), sum(room.values())


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    n, total = check(rows, packing.pack(docs, PATH).collect(), 2048)
    assert n <= 1.02 * total / 2048 + 2


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "word " * 9000), (4, "x <|endoftext|> y <|endoftext|>"), (5, "a \x1cb  c'll"), *[(k, "same words here") for k in range(10, 60)]]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "7 as class", "8 as slot", "'q' as length")
    check(rows, packing.pack(df, PATH).collect(), 2048)
    check(rows, packing.pack(df, PATH, length=64).collect(), 64)
    assert packing.pack(df.limit(0), PATH).collect() == []
    twice = packing.pack(df.where("doc_id = 10").union(df.where("doc_id = 10")), PATH).collect()
    assert len(twice) == 2 and len({(r.sequence_id, r.offset) for r in twice}) == 2


def test_cutting_stock_covers_and_is_near_the_bound():
    rng = np.random.default_rng(4)
    for _ in range(5):
        demand = rng.integers(0, 200, 64) * (rng.random(64) < 0.6)
        patterns = packing.cutting_stock(demand)
        held = sum(p * k for p, k in patterns)
        assert (held >= demand).all() and all((p * np.arange(1, 65)).sum() <= 64 for p, _ in patterns)
        small = np.where(np.arange(1, 65) <= 24, demand, 0)  # without large pieces the volume is a near bound
        assert sum(k for _, k in packing.cutting_stock(small)) <= 1.03 * (small * np.arange(1, 65)).sum() / 64 + 4
    assert packing.cutting_stock(np.zeros(8, np.int64)) == []


def test_knapsack_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(20):
        value = rng.random(6)
        best = np.zeros(13)
        for w in range(1, 13):
            best[w] = max([best[w - 1], *(best[w - s] + value[s - 1] for s in range(1, min(6, w) + 1))])
        got, count = packing.knapsack(value, 12)
        assert abs(got - best[12]) < 1e-12 and abs((count * value).sum() - got) < 1e-12 and (count * np.arange(1, 7)).sum() <= 12
