"""Byte-level BPE against the tiktoken library, and round trips."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from lineweave.llm import bpe
from lineweave.llm.hashindex import HashIndex

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    own = bpe.Bpe.load(PATH, public_tokenizers.PATTERN)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def odd_texts():
    rng = random.Random(5)
    letters = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0 　​﻿ab'stéß日本🙂12.!?é"
    out = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(800)]
    return [*out, "", "a" * 3000, "ab" * 900, "é" * 1000, "😀" * 300, "aaaa bbbb " * 50, "".join(rng.choice("abcdefgh") for _ in range(5000))]


def test_ids_and_bytes(reference):
    own = bpe.Bpe.load(PATH, public_tokenizers.PATTERN)
    texts = odd_texts()
    for text, ids in zip(texts, own.encode(texts), strict=True):
        x = np.frombuffer(ids, "<u4")
        assert x.tolist() == reference.encode_ordinary(text), repr(text[:40])
        assert own.decode(x)[0].tobytes() == text.encode()


def test_query_digests(spark, reference):
    rows = [(1, "Hello world's  end"), (2, None), (3, ""), (4, "ÀÉ" * 5000), (4, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "3 as ids", "4 as n_tokens")
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(df, PATH, public_tokenizers.PATTERN).collect())
    want = []
    for i, t in rows:
        ids = np.array(reference.encode_ordinary(t or ""), "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.digests(df.limit(0), PATH, public_tokenizers.PATTERN).collect() == []


def test_hash_index():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 2**62, 5000).astype(np.uint64))
    index = HashIndex(keys)
    assert (index.find(keys) == np.arange(len(keys))).all()
    assert (index.find(keys + np.uint64(2**62)) == -1).all()
    assert (HashIndex(keys[:0]).find(keys) == -1).all()
