from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lineweave.operators import catalog as C
from lineweave.operators import codebook, dataset, diagnostics, ranks, reviews, sequences, vectors

ROW = "id long, score_id string, part_id string, split string, instrument string, bars double, start_q double, end_q double, vector array<double>"


def rows(n=30, seed=1):
    rng = np.random.default_rng(seed)
    return [(k, f"s{k % 5}", f"p{k % 2}", "train" if k % 3 else "test", f"i{k % 4}", 1.0 + k % 4, float(k), float(k) + 2, rng.normal(size=6).tolist()) for k in range(n)]


def test_nearest_against_brute_force(spark):
    data = rows()
    x = np.array([r[8] for r in data])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame(data, ROW).repartition(3)
    for how, ok in (
        ({}, lambda q, c: q[1] != c[1]), ({"other_score": False, "same_instrument": True}, lambda q, c: q[4] == c[4]),
        ({"same_split": True, "ratio": (0.75, 1.33)}, lambda q, c: q[1] != c[1] and q[3] == c[3] and 0.75 <= c[5] / q[5] <= 1.33),
    ):
        got = {}
        for r in vectors.nearest(df, df, 4, **how).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.id)
        for q in data:
            s = sorted((-round(float(x[q[0]] @ x[c[0]]), 9), c[0]) for c in data if c[0] != q[0] and ok(q, c))[:4]
            assert got.get(q[0], []) == [i for _, i in s]
    assert vectors.nearest(df, df.limit(0), 3).collect() == []


def test_nearest_does_not_depend_on_row_order(spark):
    df = spark.createDataFrame(rows(), ROW)
    a = vectors.nearest(df, df, 3).collect()
    b = vectors.nearest(df.orderBy(F.desc("id")), df.orderBy(F.rand(3)), 3).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_mining(spark):
    v, w = [1.0, 0.0], [0.0, 1.0]
    data = [(1, "s", "p", "train", "i", 4.0, 0.0, 4.0, v), (2, "s", "p", "train", "i", 4.0, 4.0, 8.0, v), (3, "s", "p", "train", "i", 4.0, 3.0, 7.0, v), (4, "s", "q", "train", "i", 4.0, 8.0, 12.0, v), (5, "s", "p", "train", "i", 4.0, 8.0, 12.0, w), (6, "s", "p", "train", "i", 9.0, 12.0, 21.0, v)]
    got = {(r.id_a, r.id_b) for r in vectors.mine_pairs(spark.createDataFrame(data, ROW), 0.92, (0.75, 1.33), 10, 5).collect()}
    assert got == {(1, 2), (2, 1)}


def test_assignment_and_codebook(spark):
    data = [(k, [1.0, 0.02 * k]) for k in range(6)] + [(10 + k, [0.02 * k, 1.0]) for k in range(6)]
    df = spark.createDataFrame(data, "id long, vector array<double>")
    made = codebook.build(df, "id", "vector", 2)
    assert all(abs(np.linalg.norm(c) - 1) < 1e-9 for _, c in made["centroids"])
    got = made["assignments"].collect()
    assert all(r.margin >= 0 and r.cosine <= 1 + 1e-9 for r in got)
    assert len({r.cluster_id for r in got if r.id < 10}) == 1 and len({r.cluster_id for r in got}) == 2
    assert sorted(r.rank_in_cluster for r in got) == sorted([*range(1, 7)] * 2)
    single = vectors.assign(df, [(0, [1.0, 0.0])], "id", "vector").first()
    assert single.second_cosine == -1.0
    assert codebook.stability(df, "id", "vector", 2, [1, 2]).first().ari == pytest.approx(1.0)
    assert codebook.sweep(df, "id", "vector", [1, 2]).where("best").first().k == 2


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([("a", 0, "M_0000", 0.9, 0.3), ("b", 0, "M_0000", 0.8, 0.2), ("c", 1, "M_0001", 0.7, 0.1)], "id string, cluster_id int, token string, cosine double, margin double")
    c = diagnostics.cohesion(df).first()
    assert c.quantization_error == pytest.approx(0.2)
    v = diagnostics.effective_vocabulary(df, "token", 4).first()
    h = -(2 / 3 * math.log(2 / 3) + 1 / 3 * math.log(1 / 3))
    assert v.entropy == pytest.approx(h) and v.effective <= 2 and v.nominal_fraction == pytest.approx(math.exp(h) / 4)
    o = diagnostics.occupancy(df).first()
    assert (o.least, o.most, o.below_5) == (1, 2, 1.0) and o.mass_1 == pytest.approx(2 / 3)
    j = diagnostics.joint_stats(spark.createDataFrame([("m1", "r1"), ("m1", "r2"), ("m2", "r1"), (None, "r1")], "m string, r string"), "m", "r")
    s = j["summary"].first()
    assert s.joint_kinds == 3 and s.information >= -1e-12
    h = diagnostics.histogram(spark.createDataFrame([(float(x),) for x in (0, 1, 2, 10, 10)], "v double"), F.col("v"), 5)
    assert {r.bin: r.n for r in h.collect()} == {0: 2, 1: 1, 4: 2}
    same = diagnostics.histogram(spark.createDataFrame([(1.0,), (1.0,)], "v double"), F.col("v"), 5)
    assert [tuple(r) for r in same.collect()] == [(0, 2)]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3)), min_size=2, max_size=30))
def test_agreement_is_symmetric_and_blind_to_names(spark, pairs):
    df = spark.createDataFrame(pairs, "a int, b int").withColumn("c", (F.col("a") * 7 + 1) % 11)
    ab, ba, ac = (diagnostics.agreement(df, *x).first() for x in (("a", "b"), ("b", "a"), ("a", "c")))
    assert ab.ari == pytest.approx(ba.ari, abs=1e-9) and ab.nmi == pytest.approx(ba.nmi, abs=1e-9)
    assert ac.ari == pytest.approx(1.0) and ac.nmi == pytest.approx(1.0)


def test_sequences(spark):
    data = [("s", None, 2.0, "b", "x", "y"), ("s", None, 1.0, "a", "w", "y"), ("s", "v", 0.0, "c", "x", "z"), ("s", None, 2.0, "c", "w", "q")]
    df = spark.createDataFrame(data, "score_id string, voice_id string, start_q double, segment_id string, m string, r string")
    got = {r.voice_id: (r.sequence_length, r.ms, r.rs) for r in sequences.collected(df, ["score_id", "voice_id"], ["start_q", "segment_id"], ["m", "r"]).collect()}
    assert got == {None: (3, ["w", "x", "w"], ["y", "y", "q"]), "v": (1, ["x"], ["z"])}
    b = sequences.transitions(sequences.ngrams(df, ["score_id", "voice_id"], ["start_q", "segment_id"], "m", 2)).collect()
    assert {(r.t1, r.t2, r.n, r.p) for r in b} == {("w", "x", 1, 1.0), ("x", "w", 1, 1.0)}
    assert sequences.ngrams(df, ["score_id", "voice_id"], ["start_q", "segment_id"], "m", 3).count() == 1


@settings(max_examples=8, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=2, max_size=40))
def test_transitions_sum_to_one(spark, tokens):
    df = spark.createDataFrame([(1, k, t) for k, t in enumerate(tokens)], "s int, k int, t string")
    p = sequences.transitions(sequences.ngrams(df, ["s"], ["k"], "t", 2)).groupBy("t1").agg(F.sum("p").alias("p"))
    assert all(r.p == pytest.approx(1.0) for r in p.collect())


def test_votes(spark):
    data = [("r", "q1", "2024-01-02", 1, True, False, False), ("r", "q1", "2024-01-01", 2, False, False, False), ("r", "q2", "2024-01-01", 3, True, False, False), ("r", "q3", "2024-01-01", 4, None, True, False)]
    v = spark.createDataFrame(data, "run_id string, q string, timestamp string, ordinal int, won boolean, tie boolean, both_poor boolean")
    first = reviews.earliest(v, ["run_id", "q"], "timestamp", "ordinal")
    s = reviews.vote_summary(first).first()
    assert (s.votes, s.wins, s.losses, s.ties, s.decisive, s.status) == (3, 1, 1, 1, 2, "inconclusive")
    none = reviews.vote_summary(v.limit(0)).first()
    assert (none.votes, none.win_share, none.low, none.status) == (0, 0.0, 0.0, "inconclusive")
    sure = reviews.vote_summary(spark.range(60).select(F.lit(True).alias("won"), F.lit(False).alias("tie"), F.lit(False).alias("both_poor"))).first()
    assert sure.status == "pass"
    r = reviews.review_summary(spark.range(50).select(F.when(F.col("id") < 10, "coherent").otherwise("mixed").alias("rating")))
    t = reviews.trial_summary(spark.range(60).select((F.col("id") < 55).alias("same_cluster_won"), F.lit(False).alias("tie"), F.lit(False).alias("neither")))
    assert r.first().status == "fail" and t.first().status == "pass" and reviews.combined_status(r, t).first().status == "fail"


def test_selection(spark):
    data = [("a", True, True, "x.mxl"), ("b", False, True, "y.mxl"), ("c", True, False, "z.mxl"), ("d", True, True, ""), ("e", True, True, None)]
    df = spark.createDataFrame(data, "score_id string, `subset:no_license_conflict` boolean, `subset:deduplicated` boolean, mxl string")
    assert [r.score_id for r in C.subset(df, "safe_deduplicated", "mxl").collect()] == ["a"]
    with pytest.raises(ValueError, match="unknown subset"):
        C.subset(df, "nope", "mxl")
    with pytest.raises(KeyError):
        C.subset(df, "safe_rated_deduplicated", "mxl")
    with pytest.raises(KeyError):
        C.get(df, "score_id", "zz")
    assert C.get(df, "score_id", "b").mxl == "y.mxl"
    assert [r.id for r in C.evenly_spaced(spark.range(10), [F.col("id")], 4).orderBy("id").collect()] == [0, 3, 6, 9]
    assert C.evenly_spaced(spark.range(0), [F.col("id")], 4).collect() == []
    assert {r.score_id for r in C.search(df.na.fill(""), {"mxl": "^[XY]\\."}).collect()} == {"a", "b"}


def test_dataset(spark):
    note = [(60, 0.0, 1.0), (62, 1.0, 1.0), (64, 2.0, 1.0), (65, 3.0, 1.0)]
    data = [("ok", "s1", True, "explicit_voice", note, 4.0), ("sky", "s1", True, "skyline", note, 4.0), ("lic", "s2", False, "explicit_voice", note, 4.0), ("bad", "s2", True, "explicit_voice", None, 4.0), ("few", "s3", True, "explicit_voice", note[:1], 4.0), ("long", "s3", True, "explicit_voice", note, 40.0)]
    df = spark.createDataFrame(data, "segment_id string, score_id string, license boolean, extraction_mode string, notes array<struct<p:int,o:double,d:double>>, n_bars double")
    got = {r.segment_id: (r.reason, r.tokens is not None) for r in dataset.prepared(df, 2, 8, 1.0, 12.0).collect()}
    assert got == {"ok": (None, True), "sky": ("mode", False), "lic": ("license", False), "bad": ("malformed", False), "few": ("too_few_notes", False), "long": ("too_long", False)}
    p = dataset.prepared(df, 2, 8, 1.0, 12.0)
    assert p.groupBy("score_id").agg(F.countDistinct("split").alias("n")).where("n > 1").isEmpty()
    t = p.where("tokens is not null").select("segment_id", "tokens")
    e = dataset.encoded(t, "segment_id", "tokens", lambda x: np.ones((len(x), 3))).first().embedding
    assert np.allclose(np.linalg.norm(e), 1)
    neg = dataset.hard_negatives(spark.createDataFrame([(1, "A", "s1", 4.0, 5), (2, "A", "s2", 4.0, 5), (3, "B", "s1", 4.0, 5), (4, "B", "s3", 4.5, 5), (5, "C", "s4", 4.2, 9)], "id int, token string, score_id string, n_bars double, n_notes int"), spark.createDataFrame([(1, "A", "s1", 4.0, 5)], "id int, token string, score_id string, n_bars double, n_notes int"))
    assert neg.first().id == 5


def test_hard_negatives_of_many_queries(spark, monkeypatch):
    rng = np.random.default_rng(5)
    data = [(k, f"t{rng.integers(4)}", f"s{rng.integers(6)}", float(rng.integers(5)), int(rng.integers(6))) for k in range(120)]
    df = spark.createDataFrame(data, "id int, token string, score_id string, n_bars double, n_notes int")
    monkeypatch.setattr(dataset, "MOST_QUERIES", 7)
    got = {r.query_id: r.id for r in dataset.hard_negatives(df, df.where("id % 3 = 0")).collect()}
    h = lambda k: hashlib.sha1(f"42|{k}".encode()).hexdigest()
    for q in data[::3]:
        assert got[q[0]] == min((abs(c[3] - q[3]), abs(c[4] - q[4]), h(c[0]), c[0]) for c in data if c[1] != q[1] and c[2] != q[2])[3]
    assert dataset.hard_negatives(df.where("token = 't0'"), df.where("token = 't0'")).collect() == []


@pytest.mark.parametrize("size, sizes", [(3, [1, 1, 1, 1, 2, 4, 4]), (1, [1, 2, 3]), (4, [5]), (5, [1, 1, 7]), (4, [3, 6]), (2, [1, 3, 3, 2]), (16, [1] * 40)])
def test_batches_against_the_sequential_rule(spark, size, sizes):
    data = [(f"{s}-{k}", f"s{s:02d}") for s, n in enumerate(sizes) for k in range(n)]
    h = lambda k: hashlib.sha1(f"42|{k}".encode()).hexdigest()
    want, current, seen = [], [], set()
    for _, s in sorted((n, f"s{k:02d}") for k, n in enumerate(sizes)):
        for row in sorted((r for r, of in data if of == s), key=lambda r: (h(r), r)):
            if len(current) >= size or (s in seen and len(seen) < len(sizes)):
                want, current, seen = [*want, current], [], set()
            current.append(row)
            seen.add(s)
    want.append(current)
    got = {}
    for r in dataset.score_aware_batches(spark.createDataFrame(data, "id string, score_id string"), "score_id", "id", size).collect():
        got.setdefault(r.batch, set()).add(r.id)
    assert [got[k] for k in sorted(got)] == [set(b) for b in want]


def test_augmentation(spark):
    rng = np.random.default_rng(6)
    data = [(k, np.column_stack([rng.integers(2, 60, (12, 5))]).tolist() + [[0] * 5] * 3) for k in range(400)] + [(900, [[5] * 5, [6] * 5]), (901, []), (902, None)]
    df = spark.createDataFrame(data, "id int, tokens array<array<int>>")
    own = dict(data)
    plain = {r.id: r.tokens for r in dataset.augmented(df, "id", "tokens", mask_notes=0.0, mask_features=0.0, shift_times=0.0, shift_durations=0.0, thin=0.0).collect()}
    assert plain == own
    got = {r.id: r.tokens for r in dataset.augmented(df, "id", "tokens", thin=0.0).collect()}
    assert got == {r.id: r.tokens for r in dataset.augmented(df.repartition(5), "id", "tokens", thin=0.0).collect()}
    assert all(got[k] == own[k] for k in (900, 901, 902))
    a, b = np.array([own[k] for k in range(400)]), np.array([got[k] for k in range(400)])
    assert (a[:, [0, 11]] == b[:, [0, 11]]).all() and (b[:, 12:] == 0).all()
    inner_a, inner_b = a[:, 1:11], b[:, 1:11]
    hidden = inner_b == 1
    assert 0.1 < hidden.mean() < 0.19 and 0.06 < hidden.all(2).mean() < 0.14
    moved = (inner_a != inner_b) & ~hidden
    assert not moved[:, :, [0, 1, 4]].any() and ((np.abs(inner_a - inner_b) == 1) | (inner_b == 2))[moved].all() and 0.09 < moved[:, :, 2:4].mean() < 0.17 and inner_b[moved].min() >= 2
    thin = {r.id: np.array(r.tokens) for r in dataset.augmented(df.where("id < 400"), "id", "tokens", mask_notes=0.0, mask_features=0.0, shift_times=0.0, shift_durations=0.0, thin=1.0).collect()}
    gone = [12 - int((x[:, 0] != 0).sum()) for x in thin.values()]
    assert set(gone) == {0, 1, 2} and all(len(x) == 15 for x in thin.values())
    for k, x in thin.items():
        rest = x[x[:, 0] != 0].tolist()
        assert rest[0] == own[k][0] and rest[-1] == own[k][11] and [r for r in own[k][:12] if r in rest] == rest


def test_even_sampling_and_ranks_over_many_ranges(spark):
    for n, parts in ((200_000, 4), (2_000_000, 8)):
        df = spark.range(n, numPartitions=parts).select(F.xxhash64("id").alias("v"), "id")
        got = [r.v for r in C.evenly_spaced(df, [F.col("v")], 37).orderBy("v").collect()]
        place = np.sort(df.select("v").toPandas()["v"].to_numpy())
        assert got == [place[int(i * (n - 1) / 36)] for i in range(37)]
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 7 != 0, F.col("id") * 1.0).alias("v"))
    got = {r.k: (r.a, r.b) for r in ranks.quantiles(df, "v", {"a": 0.5, "b": 0.1}, ["k"]).collect()}
    for k in range(3):
        own = [float(x) for x in range(1000) if x % 3 == k and x % 7]
        assert got[k] == pytest.approx((np.quantile(own, 0.5), np.quantile(own, 0.1)))
    assert ranks.quantiles(df.limit(0), "v", {"a": 0.5}).collect() == [(None,)] and ranks.quantiles(df.limit(0), "v", {"a": 0.5}, ["k"]).collect() == []


def test_fixed_queries_and_displayed_columns(spark):
    data = [(f"p{k:03d}", f"s{k % 7}", float(k % 5), "test" if k % 2 else "train", "skyline" if k % 3 == 0 else "explicit_voice") for k in range(200)]
    df = spark.createDataFrame(data, "segment_id string, score_id string, n_bars double, split string, extraction_mode string")
    own = sorted((s, b, i) for i, s, b, split, mode in data if split == "test" and mode == "explicit_voice")
    assert {r.segment_id for r in C.fixed_queries(df, 9).collect()} == {own[int(i * (len(own) - 1) / 8)][2] for i in range(9)}
    assert C.fixed_queries(df.where("split = 'train'"), 9).collect() == [] and C.fixed_queries(df, 500).count() == len(own)


def test_batches_that_are_too_large(spark, monkeypatch):
    monkeypatch.setattr(vectors, "MOST_IN_BATCH", 3)
    with pytest.raises(ValueError, match="at most 3"):
        vectors.contrastive_loss(spark.createDataFrame([(0, k, [1.0], [1.0]) for k in range(4)], "batch int, id int, a array<double>, b array<double>"), 0.1)


def test_loss_prefers_aligned_views(spark):
    eye = np.eye(4).tolist()
    good = spark.createDataFrame([(0, k, eye[k], eye[k]) for k in range(4)], "batch int, id int, a array<double>, b array<double>")
    bad = spark.createDataFrame([(0, k, eye[k], eye[(k + 1) % 4]) for k in range(4)], "batch int, id int, a array<double>, b array<double>")
    g, b = (vectors.contrastive_loss(x, 0.1).first().loss for x in (good, bad))
    assert g < b and g == pytest.approx(math.log(1 + 3 * math.exp(-10)), abs=1e-9)


def test_alignment_lookup_and_saved_codebooks(spark, tmp_path):
    ids = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    rows_ = spark.createDataFrame([(1, "a"), (3, "c")], "id long, v string")
    assert sorted(map(tuple, C.aligned(ids, rows_, "id").collect())) == [(1, "a"), (2, None), (3, "c")]
    with pytest.raises(ValueError, match="unique"):
        C.aligned(ids, rows_.union(rows_), "id")
    with pytest.raises(KeyError):
        C.looked_up(ids, rows_, "id")
    assert C.looked_up(rows_, ids.withColumn("w", F.col("id") * 2), "id").agg(F.sum("w")).first()[0] == 8
    df = spark.createDataFrame([(k, [1.0, 0.1 * k]) for k in range(8)], "id long, vector array<double>")
    made = codebook.build(df, "id", "vector", 2)
    path = codebook.save(made, df, "id", str(tmp_path), "melody", 2, {"seed": 42})
    assert codebook.latest(spark, str(tmp_path), "melody", 2).endswith(path.rpartition("/")[2]) and codebook.latest(spark, str(tmp_path), "melody", 9) is None
    assert codebook.content_id(df, "id", {"seed": 42}) == codebook.content_id(df.orderBy(F.desc("id")), "id", {"seed": 42}) != codebook.content_id(df.limit(7), "id", {"seed": 42})
    assert spark.read.parquet(f"{path}/assignments").count() == 8


def test_more_queries_than_one_search_takes(spark, monkeypatch):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(k, k % 7, rng.normal(size=8).tolist()) for k in range(200)], "id long, score_id long, vector array<double>")
    want = sorted(map(tuple, vectors.nearest(df, df, 3).collect()))
    monkeypatch.setattr(vectors, "MOST_QUERIES", 30)
    assert len(want) == 600 and sorted(map(tuple, vectors.nearest(df, df, 3).collect())) == want
