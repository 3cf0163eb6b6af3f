"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products, one representative per group.

Each vector is owned by the cell of its most similar centre. Two linked vectors of different cells lie on both sides
of the plane between the cells, at a chord of at most sqrt(1 - c * c) from each other along it; so a vector near that
plane visits the other cell as a guest. How near is a matter of recall: in d effective dimensions a chord has a
component of about its length / sqrt(d) across a given plane, and guests within `margin` times that visit, which
bounds the copies; without a margin all within the chord's whole length do, and no link is missed. Cells are compared
in blocks of bounded size, which count links and hand on a spanning forest of them only, so a group of near copies of
any size gives as many rows as it has vectors. Vectors that are bitwise equal are compared once. Products in single
precision find candidates, double precision decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineweave.llm.common import dropped, flat, mix, whole_ids, written
from lineweave.llm.components import components

#: Bytes of double precision vectors in one side of a block product.
BLOCK_BYTES = 8 << 20
#: Vectors a cell should own; vectors the centres are fitted on at most, in number, in bytes, and of these per centre.
PER_CELL, SAMPLE, SAMPLE_BYTES, PER_CENTRE = 2048, 20_000, 32 << 20, 8
#: Guests lie within so many standard deviations of a chord's component across the plane.
MARGIN = 1.5


def _usable(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows hold a usable vector, where each row's components begin, and all components (null ones as NaN)."""
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten()
    x = values.to_numpy(zero_copy_only=False)
    off = np.concatenate([[0], np.cumsum(size)])
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    some = np.concatenate([[0], np.cumsum(np.nan_to_num(x) != 0)])
    return (size > 0) & (bad[off[1:]] == bad[off[:-1]]) & (some[off[1:]] > some[off[:-1]]), off, x


def payloads(table: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, raw, digest): each row's id, its vector's bytes and 128 bits that stand for them; null where unusable."""
    single = table.schema[vector].dataType.elementType == T.FloatType()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, off, x = _usable(batch.column(1))
            width = x.dtype.itemsize
            mask = np.packbits(ok, bitorder="little").tobytes()
            raw = pa.BinaryArray.from_buffers(pa.binary(), len(batch), [pa.py_buffer(mask), pa.py_buffer((off * width).astype(np.int32)), pa.py_buffer(x.tobytes())])
            place = np.arange(len(x)) - np.repeat(off[:-1], np.diff(off))
            word = x.view(np.uint32 if width == 4 else np.uint64).astype(np.uint64) ^ mix(place.astype(np.uint64) + np.uint64(1))
            sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(word ^ np.uint64(salt)))]) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
            digest = np.stack([c[off[1:]] - c[off[:-1]] for c in sums], 1).tobytes()
            digest = pa.BinaryArray.from_buffers(pa.binary(), len(batch), [pa.py_buffer(mask), pa.py_buffer((np.arange(len(batch) + 1) * 16).astype(np.int32)), pa.py_buffer(digest)])
            yield pa.record_batch([batch.column(0), raw, digest], names=["id", "raw", "digest"])

    return table.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(T.ArrayType(T.FloatType() if single else T.DoubleType()))).mapInArrow(run, "id long, raw binary, digest binary")


def _units(raw: list[bytes], kind: str, dims: int) -> np.ndarray:
    """Unit vectors in double precision."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), dims).astype(float)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit centres of unit rows; seeds are evenly spaced rows, so equal input gives equal centres."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), c)
    return c


def _visits(x: np.ndarray, c: np.ndarray, gap: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cell that owns each row; and (row, cell) of all visits, to cells with a higher number than the owner."""
    s = x @ c.T
    own = np.argmax(s, axis=1)
    near = s[np.arange(len(x)), own][:, None] - s <= (slack + 1e-9) * gap[own]
    near &= np.arange(len(c)) > own[:, None]
    return own, *np.nonzero(near)


def near_duplicates(table: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.9, margin: float | None = MARGIN) -> DataFrame:
    """One row per row of the table: vec_id, n_links, component_id, kept.

    Two vectors are linked when their cosine in double precision is at least `least` (above 0). n_links counts the
    other vectors linked directly, component_id is the smallest id reachable over links, the own one included, kept
    says whether that is the own one. A vector that is null, empty, zero, or holds a null or non-finite component
    links with nothing; so do vectors of different lengths with each other. A null id gives a null component and
    kept true; it and rows that repeat an id still count as vectors. Ids of another kind than whole numbers are an
    error. Only the two named columns are read. Tables of up to PER_CELL * 2 distinct vectors are one cell, compared
    in full; beyond, links between cells are found as `margin` says, all of them with None.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    whole_ids(table, key)
    spark = table.sparkSession
    rows = written(payloads(table, key, vector).select("id", "digest"), "vectors")
    known = payloads(table, key, vector).where("raw is not null").groupBy("digest").agg(F.first("raw").alias("raw"), F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
    items = written(known.withColumn("item", F.monotonically_increasing_id()), "vector-items")
    kind = "<f4" if table.schema[vector].dataType.elementType == T.FloatType() else "<f8"
    sizes = {r["n"]: r["items"] for r in items.groupBy(F.length("raw").alias("n")).agg(F.count(F.lit(1)).alias("items")).collect()}  # a row per length
    found = [_links(items.where(F.length("raw") == size), kind, size // int(kind[2]), sizes[size], least, margin) for size in sorted(sizes)]
    if found:
        pairs = found[0]
        for more in found[1:]:
            pairs = pairs.unionByName(more)
        pairs = written(pairs, "vector-links")
        counted = pairs.groupBy(F.col("a").alias("item")).agg(F.sum("n").alias("n"))
        label = components(pairs.where("b is not null"))
    else:
        counted = spark.createDataFrame([], "item long, n long")
        label = spark.createDataFrame([], "node long, component long")
    label = label.select(F.col("node").alias("item"), "component")
    of = items.select("item", "digest", "first", "copies").join(counted, "item", "left").join(label, "item", "left").select(
        "digest", F.coalesce("component", "item").alias("component"), "first", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    of = written(of, "vector-components")
    dropped(spark, items)
    least_id = of.groupBy("component").agg(F.min("first").alias("component_id"))
    named = of.join(least_id, "component").select("digest", "n_links", "component_id")
    linked = rows.where("digest is not null").join(named, "digest").select("id", "n_links", "component_id")
    alone = rows.where("digest is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("id").alias("vec_id"),
        F.col("n_links").cast("long").alias("n_links"),
        F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"),
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def _links(items: DataFrame, kind: str, dims: int, n: int, least: float, margin: float | None) -> DataFrame:
    """(a, n, b): rows with b null count links of item a, in vectors; rows with b tell of a link a - b of the forest."""
    most = int(np.clip(SAMPLE_BYTES // (8 * dims), 256, SAMPLE))
    sample = items.select("raw", F.xxhash64("digest").alias("h")).orderBy("h", "raw").limit(most).collect()  # at most SAMPLE_BYTES
    x = _units([r["raw"] for r in sample], kind, dims)
    centres = spherical_kmeans(x, int(np.clip(n // PER_CELL, 1, max(1, len(x) // PER_CENTRE))))
    spread = np.linalg.eigvalsh(np.atleast_2d(np.cov(x.T))) if len(x) > 1 else np.ones(1)
    effective = max(1.0, float(spread.sum() ** 2 / max((spread**2).sum(), 1e-300)))
    reach = float(np.sqrt(1 - least * least))
    slack = reach if margin is None else min(reach, margin * reach / np.sqrt(effective))
    block = max(16, BLOCK_BYTES // (8 * dims))

    def gaps() -> np.ndarray:
        return np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 1e-30))

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_n, guest_n, gap = np.zeros(len(centres), np.int64), np.zeros(len(centres), np.int64), gaps()
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                own, _, cell = _visits(_units(batch.column(0)[lo : lo + 1024].to_pylist(), kind, dims), centres, gap, slack)
                own_n += np.bincount(own, minlength=len(centres))
                guest_n += np.bincount(cell, minlength=len(centres))
        some = np.flatnonzero(own_n + guest_n)
        yield pa.record_batch([flat(some, pa.int32()), flat(own_n[some], pa.int64()), flat(guest_n[some], pa.int64())], names=["cell", "o", "g"])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gap = gaps()
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                part = batch.slice(lo, 1024)
                own, row, cell = _visits(_units(part.column(1).to_pylist(), kind, dims), centres, gap, slack)
                at = np.concatenate([np.arange(len(own)), row])
                yield pa.record_batch([*part.take(flat(at, pa.int64())).columns, flat(np.concatenate([own, cell]), pa.int32()), flat(np.arange(len(at)) >= len(own), pa.bool_())], names=["item", "raw", "copies", "cell", "guest"])

    # block pairs of each cell: owners among themselves (each pair of blocks once) and owners with guests
    size = items.select("raw").mapInArrow(sized, "cell int, o long, g long").groupBy("cell").agg(F.sum("o").alias("o"), F.sum("g").alias("g"))
    size = size.where("o > 0").select("cell", F.ceil(F.col("o") / block).cast("int").alias("ob"), F.ceil(F.col("g") / block).cast("int").alias("gb"))
    of = items.sparkSession.createDataFrame(size.collect(), size.schema)  # a row per centre
    put = (
        items.select("item", "raw", "copies").mapInArrow(dealt, "item long, raw binary, copies long, cell int, guest boolean").join(F.broadcast(of), "cell")
        .withColumn("block", F.when(F.col("guest"), F.col("ob") + F.pmod(F.xxhash64("item"), F.greatest(F.col("gb"), F.lit(1)))).otherwise(F.pmod(F.xxhash64("item"), F.greatest(F.col("ob"), F.lit(1)))))
        .withColumn("with", F.expr("case when guest then sequence(0, ob - 1) else sequence(0, ob + gb - 1) end"))
        .select("item", "raw", "copies", "cell", "block", F.explode("with").alias("other"))
        .withColumn("left", F.least("block", "other"))
        .withColumn("right", F.greatest("block", "other"))
    )

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        left = int(pdf["left"].iloc[0])
        right = int(pdf["right"].iloc[0])
        x = _units(list(pdf["raw"]), kind, dims)
        rough = x.astype(np.float32)
        item, copies, block = pdf["item"].to_numpy(), pdf["copies"].to_numpy(), pdf["block"].to_numpy()
        a, b = np.flatnonzero(block == left), np.flatnonzero(block == right)
        count, root, forest = np.zeros(len(pdf), np.int64), np.arange(len(pdf)), []

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        y = rough[b].T
        for lo in range(0, len(a), 256):
            own = a[lo : lo + 256]
            maybe = rough[own] @ y >= least - 1e-4
            if left == right:
                maybe[np.arange(len(own)), np.searchsorted(b, own)] = False
            r, c = np.nonzero(maybe)
            hit = np.concatenate([np.zeros(0, bool), *((x[own[r[k : k + 8192]]] * x[b[c[k : k + 8192]]]).sum(1) >= least for k in range(0, len(r), 8192))])
            r, c = r[hit], c[hit]
            np.add.at(count, own[r], copies[b[c]])
            if left != right:
                np.add.at(count, b[c], copies[own[r]])
            for k in np.flatnonzero(np.diff(r, prepend=-1)):  # where a row's hits begin
                i, mates = own[r[k]], b[c[k : np.searchsorted(r, r[k], side="right")]]
                i_root = find(i)
                for j in mates[root[mates] != i_root]:
                    j_root = find(j)
                    if j_root != i_root:
                        root[max(i_root, j_root)] = min(i_root, j_root)
                        i_root = min(i_root, j_root)
                        forest.append((item[i], item[j]))
        some = np.flatnonzero(count)
        out = pd.DataFrame({"a": item[some], "n": count[some], "b": pd.array([None] * len(some), "Int64")})
        links = pd.DataFrame({"a": [p[0] for p in forest], "n": [0] * len(forest), "b": pd.array([p[1] for p in forest], "Int64")})
        return pd.concat([out, links], ignore_index=True) if forest else out

    return put.groupBy("cell", "left", "right").applyInPandas(product, "a long, n long, b long")
