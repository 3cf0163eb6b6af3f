"""Language identification: held-out accuracy, rejection and edge cases."""

from __future__ import annotations

import zlib

import numpy as np

from lineweave.llm import langid

DIR = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_columns(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    assert sum(r.rejected for r in got) <= 0.002 * len(got)


def test_rejects_what_is_far_and_marks_what_has_no_letter(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    model = langid.train(docs, "lang", "text", "doc_id")
    rows = [(1, None), (2, ""), (3, "123 $$ ..."), (4, "zxqj vkwp qqzx jjvk " * 30), (5, "これは日本語の文章です。今日は天気がいいですね。" * 3), (6, "the with and of that this"), (6, "the with and of that this")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as lang_pred", "2 as score")
    got = {r.doc_id: r for r in langid.predict(df, model).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and all(got[k].score == 0 for k in (1, 2, 3))
    assert got[4].rejected and got[5].rejected and not got[6].rejected and got[6].lang_pred == "en"
    assert langid.predict(df, model).count() == len(rows)
    kept = langid.without_rejected(df, model)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [6, 6]
    assert langid.predict(df.limit(0), model).collect() == []


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "words", None), (2, None, "en")], "doc_id long, text string, lang string")
    got = langid.identify(docs).collect()
    assert {(r.doc_id, r.lang_pred, r.rejected) for r in got} == {(1, "und", True), (2, "und", True)}


def test_idf_counts_all_training_texts(spark):
    """However few texts the centroids are fitted on."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet").where("lang is not null and text rlike '[a-z]'")
    texts = [r.t.encode() for r in docs.selectExpr("lower(text) as t").collect()]
    held = np.zeros(langid.DIMS, np.int64)
    for t in texts:
        held += langid.counts(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] > 0
    want = np.log((1 + len(texts)) / (1 + held)) + 1
    assert np.allclose(langid.train(docs, "lang", "text", "doc_id", per_slot=1).idf, want, atol=1e-5)


def test_rows_that_repeat_an_id_are_bounded(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").where("lang is not null")
    one = docs.where("lang = 'en'").selectExpr("cast(7 as long) as doc_id", "text", "lang")
    many = docs.where("lang <> 'en'").select("doc_id", "text", "lang").unionByName(one)
    model = langid.train(many, "lang", "text", "doc_id", per_slot=3)
    got = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id")
    assert got.where("lang = lang_pred").count() >= 0.97 * docs.count()
    assert langid.train(one, "lang", "text", "doc_id", per_slot=3, centroids=9).language == ["en"] * 3  # three rows were fitted


def test_predictions_against_brute_force(spark):
    """TF-IDF of trigrams, cosines with the centroids and thresholds, text by text."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.train(docs, "lang", "text", "doc_id")
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    for r in docs.where("text is not null").collect():
        raw = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in r.text.lower().encode())
        tf = np.zeros(langid.DIMS)
        for k in range(len(raw) - 2):
            if raw[k : k + 3] != b"   ":
                code = raw[k] << 16 | raw[k + 1] << 8 | raw[k + 2]
                tf[(code * 0x9E3779B1 & 0xFFFFFFFF) >> 20] += 1
        v = np.log1p(tf) * model.idf
        cos = model.centroids @ (v / max(np.linalg.norm(v), 1e-12))
        best = int(np.argmax(cos))
        p = got[r.doc_id]
        if any(c.isalpha() for c in r.text):
            assert abs(p.score - cos[best]) < 1e-4 and (p.lang_pred == model.language[best] or np.sort(cos)[-1] - np.sort(cos)[-2] < 1e-4)
            limit = model.threshold[best] * min(np.count_nonzero(tf) / langid.FULL, 1) ** 0.5
            assert p.rejected == (cos[best] < limit) or abs(cos[best] - limit) < 1e-4


def test_a_language_that_was_not_learned_is_rejected(spark):
    """Leaving each language out in turn; hardly any text of the learned ones is rejected."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet").where("lang is not null and n_chars >= 200")
    for lang in sorted(r.lang for r in docs.select("lang").distinct().collect()):
        model = langid.train(docs.where(docs.lang != lang), "lang", "text", "doc_id")
        told = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id")
        left = told.where(told.lang == lang)
        assert left.where("rejected").count() >= 0.95 * left.count()
        others = told.where(told.lang != lang)
        assert others.where("rejected").count() <= 0.005 * others.count()
