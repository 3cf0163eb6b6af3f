"""Codebooks: spherical k-means, assignment, stability, sweeps and principal components (survey V2g, V5, V7-V9)."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.functions.expressions import hash_order, token_name, unit
from lineweave.operators import diagnostics, moments, vectors
from lineweave.sources.scratch import written

#: Rows and bytes of vectors that one start of a fit holds at most.
MOST_ROWS, MOST_BYTES = 1 << 18, 1 << 28
#: Hexadecimal digits of the hash by which rows are counted before a sample is drawn.
DIGITS = 4


def sample(rows: DataFrame, key: str, n: int | None, seed: int = 42) -> DataFrame:
    """N rows in a seeded hash order, all without n; a fit's bound, not a result's.

    Rows are counted by the first digits of their hash. All rows of the steps before the one that the last row falls into
    are taken where they lie; only that step is sorted, so no task sees all rows or the sample.
    """
    if n is None:
        return rows
    order = hash_order(seed, F.col(key))
    step, before = F.substring(order, 1, DIGITS), 0
    for at, count in sorted(map(tuple, rows.groupBy(step).count().collect())):  # 16 ** DIGITS rows at most
        if before + count > n:
            return rows.where(step < at).unionByName(rows.where(step == at).orderBy(order, key).limit(n - before))
        before += count
    return rows


def fit(rows: DataFrame, key: str, vector: str, k: int, seed: int = 42, fit_sample: int | None = 100_000, batch: int = 8192, steps: int = 300, n_init: int = 3) -> list[tuple[int, list[float]]]:
    """V5: k unit centroids of the unit vectors, numbered from 0: mini-batch spherical k-means, the best of n_init starts.

    Fitted on fit_sample rows at most, MOST_BYTES of vectors at most, in a seeded hash order: each start is a task that
    holds the sample, draws its batches from it and gives its centroids and their inertia. The same rows give the same
    centroids however they lie. Null vectors don't count; of fewer than k distinct vectors some are centroids twice.
    """
    own = rows.where(F.col(vector).isNotNull())
    dims = own.select(F.size(vector).alias("d")).first()
    if dims is None:
        raise ValueError("no vectors to fit a codebook on")
    most = min(fit_sample or MOST_ROWS, MOST_ROWS, max(1, MOST_BYTES // (8 * max(1, dims["d"]))))
    x = sample(own, key, most, seed).select(hash_order(seed, F.col(key)).alias("h"), F.col(key).cast("string").alias("key"), unit(F.col(vector)).alias("v"))
    x = x.select("*", F.explode(F.array(*[F.lit(i) for i in range(n_init)])).alias("start"))  # after the lengths, which all starts share

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        start, pdf = int(pdf["start"].iloc[0]), pdf.sort_values(["h", "key"])
        found, inertia = mini_batch(np.stack(pdf["v"].to_numpy()).astype(float), k, seed * 1000 + start, batch, steps)
        return pd.DataFrame({"start": start, "inertia": inertia, "cluster_id": range(k), "centroid": list(found)})

    made = x.groupBy("start").applyInPandas(run, "start int, inertia double, cluster_id int, centroid array<double>")
    best = made.groupBy("start").agg(F.min("inertia").alias("inertia"), F.array_sort(F.collect_list(F.struct("cluster_id", "centroid"))).alias("c")).orderBy("inertia", "start").first()  # k centroids
    return [(r["cluster_id"], list(r["centroid"])) for r in best["c"]]


def _spread(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k rows, each drawn in proportion to its distance from those before it; the nearest of a few draws counts."""
    centres = [x[rng.integers(len(x))]]
    far = np.maximum(1 - x @ centres[0], 0)
    for _ in range(k - 1):
        total = far.sum()
        draws = rng.choice(len(x), 3, p=far / total) if total > 1e-12 else rng.integers(len(x), size=3)
        tried = np.minimum(far[:, None], np.maximum(1 - x @ x[draws].T, 0))
        at = int(np.argmin(tried.sum(0)))
        centres.append(x[draws[at]])
        far = tried[:, at]
    return np.array(centres)


def mini_batch(x: np.ndarray, k: int, seed: int, batch: int, steps: int) -> tuple[np.ndarray, float]:
    """Unit centres of unit rows and their inertia, the sum of 1 - cosine.

    A centre moves to a batch's rows by their share of all rows that it has seen, which halves after each pass, so that
    early places fade; one that has seen under a hundredth of the most seen takes a row of the batch. Ten steps
    without a gain of a ten-thousandth end it.
    """
    rng = np.random.default_rng(seed)
    centres = _spread(x[rng.permutation(len(x))[: max(batch, 3 * k)]], k, rng)
    seen, best, stale, passed = np.zeros(k), np.inf, 0, 0
    for step in range(steps):
        rows = x[rng.choice(len(x), batch, replace=False)] if batch < len(x) else x
        s = rows @ centres.T
        own = np.argmax(s, axis=1)
        n = np.bincount(own, minlength=k).astype(float)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        passed += len(rows)
        if passed >= len(x):
            seen, passed = seen / 2, 0
        seen += n
        hit = n > 0
        centres[hit] += (sums[hit] - n[hit, None] * centres[hit]) / seen[hit, None]
        poor = np.flatnonzero(seen < 0.01 * seen.max())
        if len(poor) and step % 10 == 9:
            centres[poor], seen[poor] = rows[rng.integers(len(rows), size=len(poor))], np.median(seen)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-8)
        now = float(np.mean(1 - s.max(1)))
        stale = 0 if now < best * (1 - 1e-4) else stale + 1
        best = min(best, now)
        if stale >= 10:
            break
    return centres, float(sum((1 - (x[lo : lo + 4096] @ centres.T).max(1)).sum() for lo in range(0, len(x), 4096)))


def build(rows: DataFrame, key: str, vector: str, k: int, prefix: str = "M", seed: int = 42, fit_sample: int | None = 100_000) -> dict[str, DataFrame | list]:
    """V7: centroids, ranked assignments with tokens, and the statistics of clusters, sizes and cohesion."""
    centroids = fit(rows, key, vector, k, seed, fit_sample)
    assigned = vectors.ranked(written(vectors.assign(rows, centroids, key, vector), "assigned"), key).withColumn("token", token_name(prefix, F.col("cluster_id")))
    return {
        "centroids": centroids, "assignments": assigned, "cluster_stats": diagnostics.cluster_stats(assigned),
        "occupancy": diagnostics.occupancy(assigned), "cohesion": diagnostics.cohesion(assigned), "vocabulary": diagnostics.effective_vocabulary(assigned, "token", k),
    }


def sweep(rows: DataFrame, key: str, vector: str, sizes: list[int], prefix: str = "M", **how) -> DataFrame:
    """A codebook per size, compared: size, error, entropy and which one has the least error."""
    out = None
    for k in sizes:
        # neither ranks nor quantiles are compared, so rows are assigned once and not sorted
        assigned = written(vectors.assign(rows, fit(rows, key, vector, k, **how), key, vector), "assigned")
        means = assigned.agg(F.avg(1 - F.col("cosine")).alias("quantization_error"), F.avg("margin").alias("mean_margin"))
        vocabulary = diagnostics.effective_vocabulary(assigned, "cluster_id", k)
        one = means.select(F.lit(k).alias("k"), "quantization_error", "mean_margin").join(F.broadcast(vocabulary.select("entropy", "effective")))
        out = one if out is None else out.unionByName(one)
    return diagnostics.compared(out, "k", "quantization_error")


def stability(rows: DataFrame, key: str, vector: str, k: int, seeds: list[int], fit_sample: int | None = 100_000) -> DataFrame:
    """V9: agreement of the labellings of each pair of seeds on one sample; mean 1 without pairs."""
    base = written(sample(rows.select(key, vector), key, fit_sample), "sample")
    labelled = base.select(key)
    for s in seeds:
        got = vectors.assign(base, fit(base, key, vector, k, s, None), key, vector).select(key, F.col("cluster_id").alias(f"c{s}"))
        labelled = labelled.join(got, key)
    labelled, out = written(labelled, "labelled"), None
    for a, b in combinations(seeds, 2):
        one = diagnostics.agreement(labelled, f"c{a}", f"c{b}").select(F.lit(a).alias("seed_a"), F.lit(b).alias("seed_b"), "ari", "nmi")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else rows.sparkSession.createDataFrame([(seeds[0], seeds[0], 1.0, 1.0)], "seed_a int, seed_b int, ari double, nmi double")


def components(rows: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """V2g: (key, components): the centred vectors on the first principal components of all of them."""
    return moments.fit(rows, vector, dims, scaled=False).apply(rows, key, vector)


def content_id(rows: DataFrame, key: str, settings: dict) -> str:
    """Sixteen hex digits that depend on the settings and the set of keys, computed without collecting them."""
    from lineweave.sources.tables import checksum

    own = rows.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(F.col(key).cast("string"))).alias("x"), F.sum(F.xxhash64(F.lit("s"), F.col(key).cast("string")) % 1_000_003).alias("s")).first()
    return checksum({"settings": settings, "rows": [own["n"], own["x"], own["s"]]})[:16]


def save(made: dict, rows: DataFrame, key: str, root: str, space: str, k: int, settings: dict) -> str:
    """Assignments, centroids, statistics and a manifest under space and k; gives the folder."""
    from lineweave.sources import tables

    spark = rows.sparkSession
    path = f"{root}/{space}/k{k}/{content_id(rows, key, settings | {'space': space, 'k': k})}"
    for name in ("assignments", "cluster_stats", "occupancy", "cohesion", "vocabulary"):
        tables.write_parquet(made[name], f"{path}/{name}")
    tables.write_parquet(spark.createDataFrame(made["centroids"], "cluster_id int, centroid array<double>"), f"{path}/centroids")
    tables.write_json(spark, settings | {"space": space, "k": k}, f"{path}/codebook_manifest.json")
    return path


def latest(spark, root: str, space: str, k: int) -> str | None:
    """The last codebook of a space and size, by name; None where there is none."""
    from lineweave.sources import tables

    found = tables.manifests(spark, f"{root}/{space}/k{k}", "codebook_manifest.json").orderBy(F.desc("path")).first()
    return found and found["path"]
