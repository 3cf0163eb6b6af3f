"""Token counts from flat token files: end-of-document ids and nothing else tell where a document ends.

Files hold 16-bit big-endian ids without any index, and may be of any size: tasks open them by ranges. Each range is
searched for the end id in one vectorised comparison and leaves a summary (ids, separators, first and last of them,
lengths between). A prefix scan over the summaries, in two levels so that one huge file isn't one task, stitches the
documents that cross ranges.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineweave.llm.bpe import Bpe
from lineweave.llm.common import buffers, flat, lists, shared_path, steps, written

#: Ends each document; free in vocabularies of up to 50,304 ids.
END_ID = 0xC480
#: Ids of one range.
BLOCK_IDS = 1 << 20
#: Ranges of one file that the first level of the prefix scan takes together.
SPAN = 4096


def _store(path: str):
    """The file system of a folder or file that all executors reach (file, hdfs, s3, gs), and the path on it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def write_flat(docs: DataFrame, path: str, vocabulary: str, pattern: str, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write each partition's documents, in their order, as one flat file of ids under path, END_ID after each document.

    Gives (file, doc_index, id, length): a row per document with its number in its file, and one per file with its
    length in bytes and no document. Only files named there count: a task that was run again has left others. A null
    or empty text is a document without ids. The vocabulary must have fewer ids than END_ID.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, end = _encoding(vocabulary, pattern), np.array([END_ID], ">u2").tobytes()
        name, out, n, size = f"{path.rstrip('/')}/{uuid.uuid4().hex}", None, 0, 0
        for batch in batches:
            if out is None:
                store, at = _store(name)
                store.create_dir(at.rpartition("/")[0], recursive=True)
                out = store.open_output_stream(at)
            data, off = buffers(batch.column(1))
            for lo, hi in steps(off):
                raw, cuts = data[off[lo] : off[hi]].tobytes(), (off[lo : hi + 1] - off[lo]).tolist()
                ids = [encoding.encode_to_numpy(raw[a:b].decode("utf-8", "replace"), disallowed_special=()) for a, b in zip(cuts, cuts[1:], strict=False)]
                part = b"".join(x.astype(">u2").tobytes() + end for x in ids)
                out.write(part)
                size += len(part)
            here = len(batch)
            yield pa.record_batch([pa.array([name] * here), flat(np.arange(n, n + here), pa.int64()), batch.column(0), pa.nulls(here, pa.int64())], names=["file", "doc_index", "id", "length"])
            n += here
        if out is not None:
            out.close()
            yield pa.record_batch([pa.array([name]), flat([n], pa.int64()), pa.nulls(1, batch.schema.field(0).type), flat([size], pa.int64())], names=["file", "doc_index", "id", "length"])

    rows = docs.select(F.col(key), F.col(text_col).cast("string"))
    return written(rows.mapInArrow(run, f"file string, doc_index long, id {kind}, length long"), "flat-documents")


def _encoding(vocabulary: str, pattern: str):
    import tiktoken

    ranks = Bpe.load(vocabulary, pattern).ranks
    if max(ranks.values()) >= END_ID:
        raise ValueError("the vocabulary uses the end id")
    return tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(file, length) of all files of a folder; their contents are not read."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length")


def count_tokens(files: DataFrame, block_ids: int = BLOCK_IDS, end_id: int = END_ID) -> DataFrame:
    """One row per document of the files: file, doc_index (from 0), start (its first id's position), n_tokens, complete.

    files has file (its path) and length in bytes, each file once. Ids after a file's last end id are a last document
    with complete = false; an end id right after another one ends a document without ids. An odd number of bytes is an
    error, a file without bytes has no documents. Extra columns are not read.
    """
    size = 2 * block_ids
    cut = files.where("length > 0").select(F.col("file").cast("string"), F.col("length").cast("long"), F.explode(F.expr(f"sequence(0L, (length - 1) div {size})")).alias("block"))
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut.repartition(tasks, "file", "block").select("file", "block", F.least(F.lit(size), F.col("length") - F.col("block") * size).alias("size"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = {}
        for batch in batches:
            for i in range(len(batch)):
                file, block, n = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                if n & 1:
                    raise ValueError(f"{file} has half an id")
                if file not in opened:
                    store, at = _store(file)
                    opened = {file: store.open_input_file(at)}  # one file is open at a time
                ends = np.flatnonzero(np.frombuffer(opened[file].read_at(n, block * size), ">u2") == end_id)
                some = len(ends) > 0
                yield pa.record_batch(
                    [batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), *(pa.array([v], pa.int64()) for v in (n // 2, len(ends), ends[0] if some else None, ends[-1] if some else None)),
                     lists((np.diff(ends) - 1).astype(np.int32), np.array([max(len(ends) - 1, 0)]), pa.int32())],
                    names=["file", "block", "n", "k", "first", "last", "inner"],
                )

    seen = written(dealt.mapInArrow(scan, "file string, block long, n long, k long, first long, last long, inner array<int>"), "blocks")
    seen = seen.withColumn("span", F.expr(f"block div {SPAN}"))
    ahead = Window.partitionBy("file", "span").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    near = seen.select("*", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ids0"), F.coalesce(F.sum("k").over(ahead), F.lit(0)).alias("docs0"))
    near = near.select("*", F.max(F.col("ids0") + F.col("last")).over(ahead).alias("last0"))
    spans = near.groupBy("file", "span").agg(F.sum("n").alias("n_s"), F.sum("k").alias("k_s"), F.max(F.col("ids0") + F.col("last")).alias("last_s"))
    over = Window.partitionBy("file").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("*", F.coalesce(F.sum("n_s").over(over), F.lit(0)).alias("ids1"), F.coalesce(F.sum("k_s").over(over), F.lit(0)).alias("docs1"))
    spans = spans.select("file", "span", "ids1", "docs1", (F.col("ids1") + F.col("last_s")).alias("own"), "n_s", "k_s", F.max(F.col("ids1") + F.col("last_s")).over(over).alias("last1"))
    placed = near.join(spans, ["file", "span"])
    begin = F.coalesce(F.col("ids1") + F.col("last0"), F.col("last1"), F.lit(-1)) + 1
    here = F.col("ids1") + F.col("ids0")
    head = placed.where("k > 0").select("file", (F.col("docs1") + F.col("docs0")).alias("doc"), begin.alias("begin"), (here + F.col("first") - begin).alias("n_tokens"), (here + F.col("first")).alias("end"), "inner")
    # the lengths between a block's separators, each with the sum of those before it
    lengths = F.concat(F.array(F.col("n_tokens")), F.col("inner").cast("array<long>"))
    found = head.select("file", "doc", "begin", F.posexplode(lengths).alias("j", "n_tokens"))
    run = Window.partitionBy("file", "doc").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
    whole = found.select("file", (F.col("doc") + F.col("j")).alias("doc_index"), (F.col("begin") + F.coalesce(F.sum(F.col("n_tokens") + 1).over(run), F.lit(0))).alias("start"), "n_tokens", F.lit(True).alias("complete"))
    total = spans.groupBy("file").agg(F.sum("n_s").alias("n"), F.sum("k_s").alias("doc_index"), (F.coalesce(F.max("own"), F.lit(-1)) + 1).alias("start"))
    rest = total.where("n > start").select("file", "doc_index", "start", (F.col("n") - F.col("start")).alias("n_tokens"), F.lit(False).alias("complete"))
    return whole.unionByName(rest)


def count_documents(docs: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> DataFrame:
    """(doc_id, n_tokens): one row per row of docs, counted from flat files that are written into the shared folder.

    A null or empty text has no tokens; a null id stays null and rows that repeat an id each get a row. The result
    doesn't depend on how docs is partitioned. Only the two named columns are read; an empty table gives no rows.
    """
    side = write_flat(docs, shared_path(docs.sparkSession, "flat"), vocabulary, pattern, key, text_col)
    found = count_tokens(side.where("length is not null").select("file", "length"), block_ids)
    named = side.where("length is null").select("file", "doc_index", F.col("id").alias("doc_id"))
    return named.join(found, ["file", "doc_index"]).select("doc_id", "n_tokens")
