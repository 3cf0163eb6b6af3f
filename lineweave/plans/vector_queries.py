"""Queries over vectors, codebooks, token sequences and votes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineweave.functions import expressions as X
from lineweave.operators import codebook, dataset, diagnostics, reviews, segment, sequences, vectors
from lineweave.operators import notes as N
from lineweave.operators.catalog import first_per_key
from lineweave.plans import note_queries
from lineweave.plans.catalog_queries import table

_r = note_queries._r


def segment_vectors(spark, d) -> DataFrame:
    """embeddings as segments: fifty scores, three parts, lengths of one to eight bars, four bars between starts."""
    v = F.col("vec_id")
    return table(spark, d, "embeddings").select(
        v.alias("id"), (v % 50).alias("score_id"), (v % 3).alias("part_id"), F.col("label").alias("instrument"), (F.lit(1) + v % 8).cast("double").alias("bars"),
        (F.floor(v / 50) * 4).cast("double").alias("start_q"), (F.floor(v / 50) * 4 + 4).cast("double").alias("end_q"), X.hash_split(42, v % 50, 0.8, 0.1).alias("split"),
        F.col("embedding").alias("vector"), "label",
    )


_P = """p as materialized (select vec_id as id, vec_id % 50 as score_id, vec_id % 3 as part_id, label as instrument, (1 + vec_id % 8)::double as bars, (vec_id // 50 * 4)::double as start_q, (vec_id // 50 * 4 + 4)::double as end_q,
  case when x < 0.8::double then 'train' when x < 0.8::double + 0.1::double then 'validation' else 'test' end as split, label,
  list_transform(embedding::double[], lambda y: y / greatest(sqrt(list_dot_product(embedding::double[], embedding::double[])), 1e-8::double)) as v
  from (select *, ('0x' || substr(sha1('42|' || vec_id % 50), 1, 8))::bigint / 4294967295.0::double as x from embeddings))"""


#: The stated query set of searches: every row whose id is divisible by fifty, against all rows.
ASKED = "id % 50 = 0"


def _knn(spark, d, asked=ASKED, k=10, **how):
    p = segment_vectors(spark, d)
    return vectors.nearest(p, p.where(asked), k, **how).select("query_id", "rank", "id", _r("similarity", "similarity"))


def _knn_sql(where, asked="q.id % 50 = 0", k=10):
    return f"""with {_P}, s as (select q.id as query_id, c.id, round(list_dot_product(q.v, c.v), 9) as s from p q join p c on q.id <> c.id and {asked} and {where}),
      r as (select *, row_number() over (partition by query_id order by s desc, id) as rank from s) select query_id, rank::int as rank, id, round(s, 6) as similarity from r where rank <= {k}"""


def knn_cosine(spark, d):
    return _knn(spark, d)


def knn_all(spark, d):
    return _knn(spark, d, "true")


def knn_same_label(spark, d):
    return _knn(spark, d, k=5, same_instrument=True)


def knn_length_band(spark, d):
    return _knn(spark, d, k=5, ratio=(0.75, 1.33), same_split=True)


def mine_pairs(spark, d):
    return vectors.mine_pairs(segment_vectors(spark, d), 0.0, (0.5, 2.0), 5, 2).select("id_a", "id_b", "score_id", _r("similarity", "similarity"), _r("length_ratio", "length_ratio"))


def mine_pairs_reciprocal(spark, d):
    return vectors.mine_pairs(segment_vectors(spark, d), 0.0, (0.5, 2.0), 5, 2, reciprocal=True).select("id_a", "id_b", _r("similarity", "similarity"))


def pair_adjacency(spark, d):
    p = segment_vectors(spark, d)
    s = vectors.symmetric(vectors.mine_pairs(p, 0.0, (0.5, 2.0), 5, 2))
    return s.select("id", F.array_join(F.col("mates").cast("array<string>"), ",").alias("mates"))


def positive_cosine(spark, d):
    p = segment_vectors(spark, d)
    pairs = vectors.mine_pairs(p, 0.0, (0.5, 2.0), 5, 2).select("id_a", "id_b")
    return vectors.pair_cosines(pairs, p).agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("cosine"), 6).alias("mean_cosine"))


def _centroids(spark, d):
    rows = vectors.mean_centroids(table(spark, d, "embeddings"), "label", "embedding").orderBy("cluster_id").collect()  # ten labels
    return [(r["cluster_id"], list(r["centroid"])) for r in rows]


def assigned(spark, d) -> DataFrame:
    a = vectors.assign(segment_vectors(spark, d), _centroids(spark, d), "id", "vector")
    return vectors.ranked(a, "id").withColumn("token", X.token_name("M", F.col("cluster_id")))


_A = f"""{_P}, cm as (select label, i, avg(p.v0[i]) as x from (select label, embedding::double[] as v0 from embeddings) p, range(1, 65) t(i) group by all),
cc as (select label, list(x order by i) as m from cm group by 1), ce as (select label as c, list_transform(m, lambda y: y / sqrt(list_dot_product(m, m))) as cv from cc),
sc as (select id, c, round(list_dot_product(v, cv), 9) as s from p, ce), rk as (select *, row_number() over (partition by id order by s desc, c) as k from sc),
a0 as (select a.id, a.c as cluster_id, a.s as cosine, b.s as second_cosine, a.s - b.s as margin from rk a join rk b on a.id = b.id and a.k = 1 and b.k = 2),
a as materialized (select *, row_number() over (partition by cluster_id order by cosine desc, id) as rank_in_cluster, printf('M_%04d', cluster_id) as token from a0)"""


def assign_centroid(spark, d):
    return assigned(spark, d).select("id", "cluster_id", "token", "rank_in_cluster", _r("cosine", "cosine"), _r("second_cosine", "second_cosine"), _r("margin", "margin"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def cluster_stats(spark, d):
    return _rounded(diagnostics.cluster_stats(assigned(spark, d)))


def occupancy(spark, d):
    return _rounded(diagnostics.occupancy(assigned(spark, d)))


def cohesion(spark, d):
    return _rounded(diagnostics.cohesion(assigned(spark, d)))


def effective_vocab(spark, d):
    return _rounded(diagnostics.effective_vocabulary(assigned(spark, d), "token", 16))


def ari_nmi(spark, d):
    a = assigned(spark, d).join(segment_vectors(spark, d).select("id", "label"), "id")
    return _rounded(diagnostics.agreement(a, "label", "cluster_id"))


def multi_resolution(spark, d):
    a = assigned(spark, d).select("id", F.col("cluster_id").alias("child"))
    p = segment_vectors(spark, d).select("id", (F.col("label") % 5).alias("parent"))
    return _rounded(diagnostics.multi_resolution(p, a, "id", "parent", "child"))


def codebook_comparison(spark, d):
    a = assigned(spark, d)
    coarse = a.withColumn("cosine", F.col("second_cosine")).withColumn("token", (F.col("cluster_id") % 5).cast("string"))
    one = lambda x, k: diagnostics.cohesion(x).select(F.lit(k).alias("k"), "quantization_error").join(F.broadcast(diagnostics.effective_vocabulary(x, "token").select("entropy")))
    return _rounded(diagnostics.compared(one(a, 10).unionByName(one(coarse, 5)), "k", "quantization_error"))


def member_samples(spark, d):
    a = assigned(spark, d)
    out = [dataset.members(a, how, 7, "id").select(F.lit(how).alias("how"), "id") for how in ("random", "centroid-nearest", "low-confidence")]
    return out[0].unionByName(out[1]).unionByName(out[2])


def hard_negative(spark, d):
    a = assigned(spark, d).join(segment_vectors(spark, d).select("id", "score_id", F.col("bars").alias("n_bars")), "id").withColumn("n_notes", F.col("id") % 17)
    return dataset.hard_negatives(a, a.where(ASKED))


def neighbor_preservation(spark, d):
    p = segment_vectors(spark, d)
    near = vectors.nearest(p, p.where(ASKED), 10)
    return _rounded(vectors.preservation(near, assigned(spark, d), "id", 10, 3))


def preservation_means(spark, d):
    return _rounded(vectors.preservation_means(neighbor_preservation(spark, d)))


def retrieval_metrics(spark, d):
    p = segment_vectors(spark, d)
    near = vectors.nearest(p, p.where(ASKED), 10, other_score=False)
    return _rounded(vectors.retrieval_metrics(near, p.select("id", "label")))


def rerank(spark, d):
    p = segment_vectors(spark, d)
    near = vectors.nearest(p, p.where(ASKED), 50)
    short = p.select("id", X.unit(F.slice("vector", 1, 16)).alias("v"))
    second = near.select("query_id", "id").join(short, "id").join(short.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id").select("query_id", "id", F.round(X.dot(F.col("v"), F.col("q")), 9).alias("second"))
    return vectors.reranked(near, second, 10).select("query_id", "rerank", "id", _r("second", "second"))


def contrastive_loss(spark, d):
    p = segment_vectors(spark, d)
    return _rounded(vectors.contrastive_loss(p.select(F.floor(F.col("id") / 64).alias("batch"), "id", F.slice("vector", 1, 32).alias("a"), F.slice("vector", 33, 32).alias("b")), 0.1))


def vector_validity(spark, d):
    bad = F.when(F.col("vec_id") % 7 == 0, F.lit(None)).when(F.col("vec_id") % 7 == 1, F.transform("embedding", lambda x: x * 0)).when(F.col("vec_id") % 7 == 2, F.transform("embedding", lambda x: F.lit(float("nan")).cast("float"))).otherwise(F.col("embedding"))
    return table(spark, d, "embeddings").withColumn("v", bad).where(X.valid_vector(F.col("v"))).select("vec_id")


def _rows(spark, d):
    e = table(spark, d, "events")
    return e.select("user_id", "event_id", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("us"), F.col("event_type").alias("melody"), F.format_string("R_%02d", (F.get_json_object("props", "$.k").cast("int") / 10).cast("int")).alias("rhythm"), "value")


_E = "r as (select user_id, event_id, epoch_us(ts) as us, event_type as melody, printf('R_%02d', (props->>'$.k')::int // 10) as rhythm from events)"


def token_sequences(spark, d):
    s = sequences.collected(_rows(spark, d), ["user_id"], ["us", "event_id"], ["melody", "rhythm"])
    return s.select("user_id", "sequence_length", F.array_join("melodys", " ").alias("melody"), F.array_join("rhythms", " ").alias("rhythm"))


def bigram_prob(spark, d):
    b = sequences.transitions(sequences.ngrams(_rows(spark, d), ["user_id"], ["us", "event_id"], "melody", 2))
    return b.select("t1", "t2", "n", _r("p", "p"))


def trigram_counts(spark, d):
    return sequences.ngrams(_rows(spark, d), ["user_id"], ["us", "event_id"], "rhythm", 3)


def unigram_counts(spark, d):
    return sequences.ngrams(_rows(spark, d), ["user_id"], ["us", "event_id"], "melody", 1)


def turn_bigrams(spark, d):
    return sequences.ngrams(table(spark, d, "conversations"), ["conv_id"], ["turn"], "role", 2)


def sequence_stats(spark, d):
    return _rounded(sequences.length_stats(sequences.collected(_rows(spark, d), ["user_id"], ["us", "event_id"], ["melody"])))


def joint_tokens(spark, d):
    return _rounded(diagnostics.joint_stats(_rows(spark, d), "melody", "rhythm")["summary"])


def joint_top_pairs(spark, d):
    return diagnostics.joint_stats(_rows(spark, d), "melody", "rhythm")["top_pairs"]


def joint_diversity(spark, d):
    j = diagnostics.joint_stats(_rows(spark, d), "melody", "rhythm")
    return j["first_diversity"].select(F.lit("melody").alias("side"), F.col("melody").alias("token"), "kinds").unionByName(j["second_diversity"].select(F.lit("rhythm").alias("side"), F.col("rhythm").alias("token"), "kinds"))


def concentration(spark, d):
    r = _rows(spark, d).withColumn("composer", F.when(F.col("user_id") % 4 != 0, F.col("user_id") % 3))
    return _rounded(diagnostics.concentration(r, "rhythm", "user_id", "composer"))


def token_export(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang")
    m = assigned(spark, d).select("id", "token")
    r = table(spark, d, "labels").select(F.col("doc_id").alias("id"), X.token_name("R", F.col("quality")).alias("token"))
    c = r.where("id % 3 = 0").select("id", F.lit("C_0001").alias("token"))
    return sequences.exported(m, r, c, docs, "id")


def votes(spark, d) -> DataFrame:
    j = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    return j.select("doc_id", "lang", "source", (F.col("quality") == 1).alias("won"), (F.col("toxic") == 1).alias("tie"), (F.col("doc_id") % 19 == 0).alias("both_poor"))


def wilson_votes(spark, d):
    first = reviews.earliest(votes(spark, d).withColumn("unit", F.col("doc_id") % 200), ["lang", "unit"], "doc_id", "doc_id")
    return _rounded(reviews.vote_summary(first, ["lang"], 20))


def vote_total(spark, d):
    return _rounded(reviews.vote_summary(votes(spark, d)))


def _reviews(spark, d):
    first = reviews.earliest(votes(spark, d), ["lang", "source"], "doc_id", "doc_id")
    return reviews.review_summary(first.withColumn("rating", F.when(F.col("won"), "coherent").otherwise("mixed")))


def _trials(spark, d):
    v = votes(spark, d).withColumn("trial_id", F.col("doc_id") % 150)
    return reviews.trial_summary(reviews.earliest(v, ["trial_id"], "doc_id", "doc_id").withColumnsRenamed({"won": "same_cluster_won", "both_poor": "neither"}))


def cluster_reviews(spark, d):
    return _rounded(_reviews(spark, d))


def trial_status(spark, d):
    return _rounded(_trials(spark, d))


def combined_status(spark, d):
    return reviews.combined_status(_reviews(spark, d), _trials(spark, d))


def segmented_lines(spark, d):
    """M11 over note lines: cuts of best evidence; tested against all segmentations on short lines."""
    notes = note_queries.notes(spark, d)
    return segment.segment_lines(segmentation_input(notes), "score_id").select("score_id", _r("start_q", "start_q"), _r("end_q", "end_q"), "n_notes", _r("n_bars", "n_bars"))


def segmented_in_sql(spark, d):
    """2.13: segmented_lines by the table function, called in SQL."""
    notes = note_queries.notes(spark, d)
    lines = segmentation_input(notes).withColumn("line", F.col("score_id").cast("string")).drop("score_id")
    segment.register(spark)
    return spark.sql("select cast(line as bigint) as score_id, round(start_q, 6) as start_q, round(end_q, 6) as end_q, n_notes, round(n_bars, 6) as n_bars from segment_line(table({lines}) partition by line)", lines=lines)


def segmentation_input(notes: DataFrame) -> DataFrame:
    line = N.Line(["score_id"])
    ev = N.boundary_evidence(notes, line, tonic=F.lit(0)).select("score_id", F.round("o", 6).alias("t"), "evidence")
    times = N.candidate_times(notes, line).join(ev, ["score_id", "t"], "left").groupBy("score_id").agg(F.array_sort(F.collect_list(F.struct("t", F.coalesce("evidence", F.lit(0.0)).alias("e")))).alias("c"))
    onsets = notes.groupBy("score_id").agg(F.array_sort(F.collect_list("o")).alias("onsets"))
    return times.join(onsets, "score_id").join(N.measure_length(notes, line), "score_id").select("score_id", "measure_length", F.col("c.t").alias("times"), F.col("c.e").alias("evidence"), "onsets")


def encoder_dataset(spark, d):
    ph = note_queries.segments(spark, d).withColumn("segment_id", F.format_string("%d-%d", "score_id", "segment")).withColumn("license", F.col("score_id") % 10 != 0).withColumn("extraction_mode", F.when(F.col("score_id") % 7 == 0, "skyline").otherwise("explicit_voice"))
    p = dataset.prepared(ph, 5, 40, 1.5, 12.0)
    return p.select("segment_id", "split", "reason", F.size(F.coalesce("tokens", F.array().cast("array<array<int>>"))).alias("token_length"))


def batches(spark, d):
    p = segment_vectors(spark, d).select("id", "score_id")
    b = dataset.score_aware_batches(p, "score_id", "id", 16)
    return b.select("id", "score_id", "batch")


def augmented_tokens(spark, d):
    ph = note_queries.segments(spark, d)
    from lineweave.operators.features import tokens

    t = ph.select(F.format_string("%d-%d", "score_id", "segment").alias("segment_id"), tokens(F.col("notes")).alias("tokens"))
    a = dataset.augmented(t, "segment_id", "tokens")
    return a.select("segment_id", F.size("tokens").alias("n"), F.size(F.filter(F.flatten("tokens"), lambda x: x == 1)).alias("masked"))


def codebook_build(spark, d):
    made = codebook.build(segment_vectors(spark, d), "id", "vector", 8)
    return _rounded(made["cluster_stats"])


def codebook_sweep(spark, d):
    return _rounded(codebook.sweep(segment_vectors(spark, d), "id", "vector", [4, 8]))


def codebook_stability(spark, d):
    return _rounded(codebook.stability(segment_vectors(spark, d), "id", "vector", 4, [42, 43]))


def principal_components(spark, d):
    p = segment_vectors(spark, d).select("id", F.col("vector").cast("array<double>").alias("vector"))
    pc = codebook.components(p, "id", "vector", 8)
    return pc.select(F.posexplode("components").alias("component", "x")).groupBy("component").agg(F.round(F.var_pop("x"), 6).alias("variance"))


def ann_neighbors(spark, d):
    """An index built, saved, loaded and searched; ten neighbours of every query, its recall is tested."""
    from lineweave.operators import ann
    from lineweave.sources.scratch import shared_path

    p = segment_vectors(spark, d)
    path = shared_path(spark, "index")
    ann.build(p, path, cell=64)
    return ann.search(ann.load(spark, path), p.where(ASKED), 10).select("query_id", "rank", "id", _r("similarity", "similarity"))


def as_of_neighbors(spark, d):
    """For each purchase the last view before it and the first click after it, per user, within one union sort."""
    e = _rows(spark, d)
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    last = F.last(F.when(F.col("melody") == "view", F.col("us")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    nxt = F.first(F.when(F.col("melody") == "click", F.col("us")), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return e.withColumn("last_view", last).withColumn("next_click", nxt).where("melody = 'purchase'").select("event_id", "last_view", "next_click")


def session_segments(spark, d):
    """Gap-based segments of a live stream, on a bounded table: sessions with twelve hours of silence between."""
    e = table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("t", "12 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("segments"), F.max("n").alias("longest"))


QUERIES = {f.__name__: f for f in (
    knn_cosine, knn_all, knn_same_label, knn_length_band, mine_pairs, mine_pairs_reciprocal, pair_adjacency, positive_cosine, assign_centroid, cluster_stats, occupancy, cohesion,
    effective_vocab, ari_nmi, multi_resolution, codebook_comparison, member_samples, hard_negative, neighbor_preservation, preservation_means, retrieval_metrics, rerank, contrastive_loss,
    vector_validity, token_sequences, bigram_prob, trigram_counts, unigram_counts, turn_bigrams, sequence_stats, joint_tokens, joint_top_pairs, joint_diversity, concentration, token_export,
    wilson_votes, vote_total, cluster_reviews, trial_status, combined_status, segmented_lines, encoder_dataset, batches, augmented_tokens, codebook_build, codebook_sweep,
    codebook_stability, segmented_in_sql, principal_components, ann_neighbors, as_of_neighbors, session_segments,
)}

_MINE = f"""{_P}, s as (select a.id as id_a, b.id as id_b, a.score_id, round(list_dot_product(a.v, b.v), 9) as s, b.bars / greatest(1e-6::double, a.bars) as ratio from p a
  join p b on a.score_id = b.score_id and a.part_id = b.part_id and a.split = b.split and a.id <> b.id and (b.end_q <= a.start_q or b.start_q >= a.end_q) and b.bars / greatest(1e-6::double, a.bars) between 0.5 and 2.0),
mined as materialized (select * from (select *, row_number() over (partition by id_a order by s desc, id_b) as k from s where s >= 0) where k <= 2)"""
_V = "v as (select doc_id, lang, source, quality = 1 as won, toxic = 1 as tie, doc_id % 19 = 0 as poor from labels join documents using (doc_id))"


def _wilson(k, n):
    p, z = f"({k}::double / greatest({n}, 1))", 1.96
    mid, spread, scale = f"({p} + {z * z}::double / (2 * greatest({n}, 1)))", f"{z}::double * sqrt({p} * (1 - {p}) / greatest({n}, 1) + {z * z}::double / (4 * greatest({n}, 1)::double * greatest({n}, 1)))", f"(1 + {z * z}::double / greatest({n}, 1))"
    return f"case when {n} > 0 then greatest(0.0::double, ({mid} - {spread}) / {scale}) else 0 end", f"case when {n} > 0 then least(1.0::double, ({mid} + {spread}) / {scale}) else 0 end"


def _vote_sql(source, by, least):
    lo, hi = _wilson("wins", "decisive")
    head = f"{by}, " if by else ""
    return f"""with {_V}, {source}, n as (select {head} count(*) as votes, count_if(not tie and not poor and won) as wins, count_if(not tie and not poor and not won) as losses, count_if(tie) as ties, count_if(poor) as both_poor from u {'group by ' + by if by else ''}),
      m as (select *, wins + losses as decisive from n), w as (select *, {lo} as lo, {hi} as hi from m)
      select {head} votes::bigint as votes, wins::bigint as wins, losses::bigint as losses, ties::bigint as ties, both_poor::bigint as both_poor, decisive::bigint as decisive, round(case when decisive > 0 then wins / decisive::double else 0 end, 6) as win_share, round(lo, 6) as low, round(hi, 6) as high,
        case when decisive >= {least} and lo > 0.5 then 'pass' when decisive >= {least} and hi < 0.5 then 'fail' else 'inconclusive' end as status from w"""


_REV = """ru as (select * from (select *, row_number() over (partition by lang, source order by doc_id) as k from v) where k = 1),
rs as (select count(*) as reviewed, count_if(won) as coherent from ru), rv as (select *, case when reviewed > 0 then coherent / reviewed::double else 0 end as share from rs),
rx as (select *, case when reviewed >= 40 and share >= 0.65 then 'pass' when reviewed >= 40 and share < 0.40 then 'fail' else 'inconclusive' end as status from rv)"""
_LO, _HI = _wilson("same", "decisive")
_TRI = f"""tu as (select * from (select *, row_number() over (partition by doc_id % 150 order by doc_id) as k from v) where k = 1),
ts as (select count(*) as trials, count_if(not tie and not poor) as decisive, count_if(not tie and not poor and won) as same from tu), tw as (select *, greatest(0, decisive - same) as different, {_LO} as lo, {_HI} as hi from ts),
tx as (select *, case when decisive >= 50 and lo > 0.5 then 'pass' when decisive >= 50 and hi < 0.5 then 'fail' else 'inconclusive' end as status from tw)"""
_NEAR10 = """nn as (select query_id, id, s, row_number() over (partition by query_id order by s desc, id) as rank from (select q.id as query_id, c.id, round(list_dot_product(q.v, c.v), 9) as s from p q join p c on q.id <> c.id and q.id % 50 = 0 and {where}))"""
_PRES = f"""{_A}, {_NEAR10.format(where='q.score_id <> c.score_id')}, cont as (select query_id, list(id) as l from nn where rank <= 10 group by 1),
tops as (select cluster_id from a group by 1 order by max(cosine) desc, cluster_id limit 3), nearl as (select * from a where cluster_id in (select cluster_id from tops) order by cosine desc, id limit 11),
same as (select q.query_id, list_slice(list(a.id order by a.cosine desc, a.id), 1, 10) as l from cont q join a qa on qa.id = q.query_id join a on a.cluster_id = qa.cluster_id and a.id <> q.query_id group by 1),
near as (select q.query_id, list_slice(list(n.id order by n.cosine desc, n.id), 1, 10) as l from cont q, nearl n where n.id <> q.query_id group by 1),
pres as (select query_id, len(list_intersect(cont.l, coalesce(same.l, [])))::int as overlap_same, len(list_intersect(cont.l, coalesce(same.l, []))) / greatest(1, len(list_distinct(cont.l || coalesce(same.l, []))))::double as jaccard_same,
  len(list_intersect(cont.l, near.l))::int as overlap_near, len(list_intersect(cont.l, near.l)) / greatest(1, len(list_distinct(cont.l || near.l)))::double as jaccard_near from cont left join same using (query_id) left join near using (query_id))"""
_Q = ", ".join(f"round(quantile_cont(size, {q}), 6) as q{int(q * 100):02d}" for q in (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99))
_H = "-sum(n / t * ln(greatest(n / t, 1e-12::double)))"

ORACLE = {
    "knn_cosine": _knn_sql("q.score_id <> c.score_id"),
    "knn_all": _knn_sql("q.score_id <> c.score_id", "true"),
    "knn_same_label": _knn_sql("q.score_id <> c.score_id and q.instrument = c.instrument", k=5),
    "knn_length_band": _knn_sql("q.score_id <> c.score_id and q.split = c.split and c.bars / greatest(1e-6::double, q.bars) between 0.75 and 1.33", k=5),
    "mine_pairs": f"with {_MINE} select id_a, id_b, score_id, round(s, 6) as similarity, round(ratio, 6) as length_ratio from mined",
    "mine_pairs_reciprocal": f"with {_MINE} select a.id_a, a.id_b, round(a.s, 6) as similarity from mined a join mined b on a.id_a = b.id_b and a.id_b = b.id_a",
    "pair_adjacency": f"with {_MINE}, e as (select id_a, id_b from mined union select id_b, id_a from mined) select id_a as id, string_agg(id_b::varchar, ',' order by id_b) as mates from e group by 1",
    "positive_cosine": f"with {_MINE} select count(*) as pairs, round(avg(list_dot_product(a.v, b.v)), 6) as mean_cosine from mined m join p a on a.id = m.id_a join p b on b.id = m.id_b",
    "assign_centroid": f"with {_A} select id, cluster_id, token, rank_in_cluster::int as rank_in_cluster, round(cosine, 6) as cosine, round(second_cosine, 6) as second_cosine, round(margin, 6) as margin from a",
    "cluster_stats": f"""with {_A} select cluster_id, min(token) as token, count(*) as size, round(avg(cosine), 6) as mean_cosine, round(median(cosine), 6) as median_cosine, round(quantile_cont(cosine, 0.1), 6) as p10_cosine,
      round(avg(margin), 6) as mean_margin, round(median(margin), 6) as median_margin from a group by 1""",
    "occupancy": f"""with {_A}, s as (select cluster_id, count(*) as size from a group by 1), r as (select *, row_number() over (order by size desc, cluster_id) as k, count(*) over () as n, sum(size) over () as t from s)
      select min(size) as least, round(median(size), 6) as median, round(avg(size), 6) as mean, max(size) as most, {_Q}, round(avg((size < 5)::int), 6) as below_5, round(avg((size < 10)::int), 6) as below_10, round(avg((size < 25)::int), 6) as below_25,
        round(sum(case when k <= greatest(1, ceil(n * 0.01)) then size else 0 end)::double / max(t)::double, 6) as mass_1, round(sum(case when k <= greatest(1, ceil(n * 0.05)) then size else 0 end)::double / max(t)::double, 6) as mass_5,
        round(sum(case when k <= greatest(1, ceil(n * 0.1)) then size else 0 end)::double / max(t)::double, 6) as mass_10 from r""",
    "cohesion": f"""with {_A} select round(avg(cosine), 6) as mean_cosine, round(median(cosine), 6) as median_cosine, round(quantile_cont(cosine, 0.1), 6) as q10_cosine, round(quantile_cont(cosine, 0.9), 6) as q90_cosine,
      round(avg(margin), 6) as mean_margin, round(median(margin), 6) as median_margin, round(avg(1 - cosine), 6) as quantization_error from a""",
    "effective_vocab": f"""with {_A}, c as (select token, count(*)::double as n from a group by 1), t as (select sum(n) as t from c), h as (select {_H} as h, count(*) as k from c, t)
      select round(h, 6) as entropy, k as observed, round(exp(h), 6) as effective, round(exp(h) / greatest(1, k), 6) as effective_fraction, round(exp(h) / 16, 6) as nominal_fraction from h""",
    "ari_nmi": f"""with {_A}, j as (select p.label, a.cluster_id as c from a join p using (id)), ab as (select count(*)::double as n from j group by label, c), x as (select count(*)::double as n from j group by label), y as (select count(*)::double as n from j group by c),
      s as (select (select sum(n * (n - 1) / 2) from ab) as cab, (select sum(n * (n - 1) / 2) from x) as ca, (select sum(n * (n - 1) / 2) from y) as cb, (select sum(n * ln(n)) from ab) as lab, (select sum(n * ln(n)) from x) as la, (select sum(n * ln(n)) from y) as lb, (select count(*)::double from j) as t)
      select round((cab - ca * cb / (t * (t - 1) / 2)) / ((ca + cb) / 2 - ca * cb / (t * (t - 1) / 2)), 6) as ari, round(((ln(t) - la / t) + (ln(t) - lb / t) - (ln(t) - lab / t)) / (((ln(t) - la / t) + (ln(t) - lb / t)) / 2), 6) as nmi from s""",
    "multi_resolution": f"""with {_A}, n as (select p.label % 5 as parent, a.cluster_id as child, count(*) as overlap from a join p using (id) group by all)
      select parent, child, overlap, round(overlap / (sum(overlap) over (partition by parent))::double, 6) as of_parent, round(overlap / (sum(overlap) over (partition by child))::double, 6) as of_child from n""",
    "codebook_comparison": f"""with {_A}, c1 as (select token, count(*)::double as n from a group by 1), c2 as (select cluster_id % 5, count(*)::double as n from a group by 1), t as (select count(*)::double as t from a)
      select 10 as k, round((select avg(1 - cosine) from a), 6) as quantization_error, round((select {_H} from c1, t), 6) as entropy, true as best union all select 5, round((select avg(1 - second_cosine) from a), 6), round((select {_H} from c2, t), 6), false""",
    "member_samples": f"""with {_A} (select 'random' as how, id from a order by sha1('42|' || id), id limit 7) union all (select 'centroid-nearest', id from a order by cosine desc, id limit 7) union all (select 'low-confidence', id from a order by margin, cosine, id limit 7)""",
    "hard_negative": f"""with {_A}, r as (select a.id, a.token, p.score_id, p.bars, a.id % 17 as nn from a join p using (id)), q as (select * from r where id % 50 = 0)
      select query_id, id, token, score_id from (select q.id as query_id, r.id, r.token, r.score_id, row_number() over (partition by q.id order by abs(r.bars - q.bars), abs(r.nn - q.nn), sha1('42|' || r.id)) as k
        from q join r on r.token <> q.token and r.score_id <> q.score_id) where k = 1""",
    "neighbor_preservation": f"with {_PRES} select query_id, overlap_same, round(jaccard_same, 6) as jaccard_same, overlap_near, round(jaccard_near, 6) as jaccard_near from pres",
    "preservation_means": f"with {_PRES} select count(*) as queries, round(avg(overlap_same), 6) as overlap_same, round(avg(round(jaccard_same, 6)), 6) as jaccard_same, round(avg(overlap_near), 6) as overlap_near, round(avg(round(jaccard_near, 6)), 6) as jaccard_near from pres",
    "retrieval_metrics": f"""with {_P}, {_NEAR10.format(where='true')}, h as (select n.query_id, min(case when c.label = q.label then n.rank end) as f from nn n join p q on q.id = n.query_id join p c on c.id = n.id where n.rank <= 10 group by 1)
      select count(*) as queries, round(avg(coalesce((f <= 1)::int, 0)), 6) as recall_1, round(avg(coalesce((f <= 5)::int, 0)), 6) as recall_5, round(avg(coalesce((f <= 10)::int, 0)), 6) as recall_10, round(avg(coalesce(1.0::double / f, 0)), 6) as mrr from h""",
    "rerank": f"""with {_P}, {_NEAR10.format(where='q.score_id <> c.score_id')}, u as (select id, list_transform(v[1:16], lambda y: y / greatest(sqrt(list_dot_product(v[1:16], v[1:16])), 1e-8::double)) as u from p),
      s as (select n.query_id, n.id, round(list_dot_product(a.u, b.u), 9) as s from nn n join u a on a.id = n.query_id join u b on b.id = n.id where n.rank <= 50)
      select * from (select query_id, row_number() over (partition by query_id order by s desc, id)::int as rerank, id, round(s, 6) as second from s) where rerank <= 10""",
    "contrastive_loss": """with u as (select vec_id // 64 as batch, vec_id as i, embedding[1:32]::double[] as a, embedding[33:64]::double[] as b from embeddings),
      s as (select batch, l.i, r.i as j, list_dot_product(l.a, r.b) / sqrt(list_dot_product(l.a, l.a)) / sqrt(list_dot_product(r.b, r.b)) / 0.1::double as s from u l join u r using (batch)),
      x as (select batch, avg(l) as l from (select batch, ln(sum(exp(s))) - max(case when i = j then s end) as l from s group by batch, i) group by 1),
      y as (select batch, avg(l) as l from (select batch, ln(sum(exp(s))) - max(case when i = j then s end) as l from s group by batch, j) group by 1)
      select batch, round((x.l + y.l) / 2, 6) as loss from x join y using (batch)""",
    "vector_validity": "select vec_id from embeddings where vec_id % 7 not in (0, 1, 2)",
    "token_sequences": f"with {_E} select user_id, count(*)::int as sequence_length, string_agg(melody, ' ' order by us, event_id) as melody, string_agg(rhythm, ' ' order by us, event_id) as rhythm from r group by 1",
    "bigram_prob": f"with {_E}, b as (select melody as t1, lead(melody) over (partition by user_id order by us, event_id) as t2 from r), c as (select t1, t2, count(*) as n from b where t2 is not null group by all) select t1, t2, n, round(n / (sum(n) over (partition by t1))::double, 6) as p from c",
    "trigram_counts": f"with {_E}, b as (select rhythm as t1, lead(rhythm) over w as t2, lead(rhythm, 2) over w as t3 from r window w as (partition by user_id order by us, event_id)) select t1, t2, t3, count(*) as n from b where t3 is not null group by all",
    "unigram_counts": f"with {_E} select melody as t1, count(*) as n from r group by 1",
    "turn_bigrams": "with b as (select role as t1, lead(role) over (partition by conv_id order by turn) as t2, lead(1) over (partition by conv_id order by turn) as f from conversations) select t1, t2, count(*) as n from b where f = 1 group by all",
    "sequence_stats": f"with {_E}, s as (select count(*) as n from r group by user_id) select count(*) as sequences, round(median(n), 6) as median, round(quantile_cont(n, 0.1), 6) as q10, round(quantile_cont(n, 0.5), 6) as q50, round(quantile_cont(n, 0.9), 6) as q90 from s",
    "joint_tokens": f"""with {_E}, ab as (select melody, rhythm, count(*)::double as n from r group by all), x as (select sum(n) as n from ab group by melody), y as (select sum(n) as n from ab group by rhythm), t as (select sum(n) as t from ab),
      h as (select (select {_H} from ab, t) as j, (select {_H} from x, t) as f, (select {_H} from y, t) as s) select round(j, 6) as joint, (select count(*) from ab) as joint_kinds, round(f, 6) as first, (select count(*) from x) as first_kinds,
        round(s, 6) as second, (select count(*) from y) as second_kinds, round(f + s - j, 6) as information from h""",
    "joint_top_pairs": f"with {_E} select melody, rhythm, count(*) as n from r group by all order by n desc, melody, rhythm limit 20",
    "joint_diversity": f"""with {_E}, d as (select distinct melody, rhythm from r) (select 'melody' as side, melody as token, count(*) as kinds from d group by 2 order by 3 desc, 2 limit 20) union all (select 'rhythm', rhythm, count(*) from d group by 2 order by 3 desc, 2 limit 20)""",
    "concentration": f"""with {_E}, q as (select rhythm as token, user_id as s, case when user_id % 4 <> 0 then user_id % 3 end as c from r), sc as (select token, s, count(*)::double as n from q group by all), cc as (select token, c, count(*)::double as n from q where c is not null group by all),
      a as (select token, sum(n)::bigint as n, count(*) as scores, max(n) / sum(n) as ss from sc group by 1), b as (select token, count(*) as composers, max(n) / sum(n) as cs from cc group by 1)
      select token, n, scores, coalesce(composers, 0) as composers, round(ss, 6) as score_share, round(coalesce(cs, 0), 6) as composer_share, ss >= 0.5 or coalesce(cs, 0) >= 0.5 as flagged from a left join b using (token)""",
    "token_export": f"""with {_A} select a.id, a.token as melody_token, printf('R_%04d', l.quality) as rhythm_token, d.lang, case when l.doc_id % 3 = 0 then 'C_0001' end as combined_token from a join labels l on l.doc_id = a.id left join documents d on d.doc_id = a.id""",
    "wilson_votes": _vote_sql("u as (select * from (select *, row_number() over (partition by lang, doc_id % 200 order by doc_id) as k from v) where k = 1)", "lang", 20),
    "vote_total": _vote_sql("u as (select * from v)", "", 50),
    "cluster_reviews": f"with {_V}, {_REV} select reviewed, coherent::bigint as coherent, round(share, 6) as share, status from rx",
    "trial_status": f"with {_V}, {_TRI} select trials, decisive::bigint as decisive, same::bigint as same, different::bigint as different, round(lo, 6) as low, round(hi, 6) as high, status from tx",
    "combined_status": f"""with {_V}, {_REV}, {_TRI} select rx.status as reviews, tx.status as trials, case when rx.status = 'pass' and tx.status = 'pass' then 'pass' when rx.status = 'fail' or tx.status = 'fail' then 'fail' else 'inconclusive' end as status from rx, tx""",
    "encoder_dataset": f"""with {note_queries._PH}, z as (select *, ('0x' || substr(sha1('42|' || score_id), 1, 8))::bigint / 4294967295.0::double as x,
      case when score_id % 10 = 0 then 'license' when score_id % 7 = 0 then 'mode' when len(ps) < 5 then 'too_few_notes' when len(ps) > 40 then 'too_many_notes' when bars < 1.5 then 'too_short' when bars > 12 then 'too_long' end as reason from q)
      select score_id || '-' || segment as segment_id, case when x < 0.8::double then 'train' when x < 0.8::double + 0.1::double then 'validation' else 'test' end as split, reason, case when reason is null then len(ps) else 0 end::int as token_length from z""",
    "batches": f"""with recursive {_P}, c as (select score_id, count(*) as n from p group by 1),
      o as (select id, score_id, row_number() over (order by n, score_id, sha1('42|' || id), id) as i from p join c using (score_id)), t as (select count(*) as scores from c),
      go(i, id, score_id, batch, held, seen) as (select i, id, score_id, 0::bigint, 1, [score_id] from o where i = 1 union all
        select o.i, o.id, o.score_id, case when x.new then g.batch + 1 else g.batch end, case when x.new then 1 else g.held + 1 end, case when x.new then [o.score_id] else list_distinct(g.seen || [o.score_id]) end
        from go g join o on o.i = g.i + 1, t, lateral (select g.held >= 16 or (list_contains(g.seen, o.score_id) and len(g.seen) < t.scores) as new) x)
      select id, score_id, batch from go""",
    "as_of_neighbors": f"""with {_E} select event_id, last_view, next_click from (select event_id, melody, last_value(case when melody = 'view' then us end ignore nulls) over (partition by user_id order by us, event_id rows between unbounded preceding and 1 preceding) as last_view,
      first_value(case when melody = 'click' then us end ignore nulls) over (partition by user_id order by us, event_id rows between 1 following and unbounded following) as next_click from r) where melody = 'purchase'""",
    "session_segments": """with g as (select user_id, ts, case when ts >= lag(ts) over (partition by user_id order by ts) + interval 12 hours or lag(ts) over (partition by user_id order by ts) is null then 1 else 0 end as new from events),
      s as (select user_id, sum(new) over (partition by user_id order by ts rows between unbounded preceding and current row) as s from g), c as (select user_id, s, count(*) as n from s group by all)
      select user_id, count(*) as segments, max(n) as longest from c group by 1""",
}
