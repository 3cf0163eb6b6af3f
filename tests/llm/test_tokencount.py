"""Token counts from flat files against a plain scan."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from lineweave.llm import tokencount as t
from lineweave.llm.bpe import Bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def plain(ids):
    out, start = [], 0
    for k, x in enumerate(ids):
        if x == t.END_ID:
            out.append((start, k - start, True))
            start = k + 1
    return out + ([(start, len(ids) - start, False)] if start < len(ids) else [])


def files(spark, folder, contents):
    """(file, length) of new files."""
    rows = []
    for name, body in contents.items():
        (folder / name).write_bytes(body)
        rows.append((f"file://{folder}/{name}", len(body), "x"))
    return spark.createDataFrame(rows, "file string, length long, block string")


@pytest.mark.parametrize("span, size", [(1, 1), (2, 3), (4096, 16), (3, 1000)])
def test_ranges_are_stitched(spark, monkeypatch, tmp_path, span, size):
    monkeypatch.setattr(t, "SPAN", span)
    rng = random.Random(span)
    bodies, want = {}, []
    for f in range(12):
        ids = [t.END_ID if rng.random() < rng.choice([0.02, 0.3]) else rng.randrange(50256) for _ in range(rng.choice([0, 1, 7, 64, 300]))]
        ids += [t.END_ID] * (f % 3)
        bodies[f"f{f}"] = np.array(ids, ">u2").tobytes()
        want += [(f"f{f}", k, *d) for k, d in enumerate(plain(ids))]
    df = files(spark, tmp_path, bodies)
    row = lambda r: (r.file.rpartition("/")[2], r.doc_index, r.start, r.n_tokens, r.complete)
    assert sorted(map(row, t.count_tokens(df, size).collect())) == sorted(want)
    assert sorted(map(row, t.count_tokens(t.listed(spark, f"file://{tmp_path}"), size).collect())) == sorted(want)


def test_odd_files(spark, tmp_path):
    assert t.count_tokens(files(spark, tmp_path, {"a": b""})).collect() == []
    assert t.count_tokens(files(spark, tmp_path, {"a": b""}).limit(0)).collect() == []
    with pytest.raises(Exception, match="half an id"):
        t.count_tokens(files(spark, tmp_path, {"b": b"abc"})).collect()


def test_documents(spark):
    rows = [(1, "Hello there"), (2, None), (3, ""), (4, "Ā Ā ü " * 10), (5, "long " * 50_000), (5, "again"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("text", "doc_id", "1 as ids", "2 as file", "3 as length")
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=Bpe.load(PATH, public_tokenizers.PATTERN).ranks, special_tokens={})
    want = sorted((k or 0, len(enc.encode_ordinary(x or ""))) for k, x in rows)
    for parts, block in ((1, 1 << 20), (2, 100), (5, 7)):
        got = t.count_documents(docs.repartition(parts), PATH, public_tokenizers.PATTERN, block_ids=block).collect()
        assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == want
    assert t.count_documents(docs.limit(0), PATH, public_tokenizers.PATTERN).collect() == []
    assert t.count_documents(docs.withColumn("doc_id", docs.text), PATH, public_tokenizers.PATTERN).schema["doc_id"].dataType.simpleString() == "string"
