"""WARC records in a content-addressed archive: payloads once by digest, exact headers apart, records rebuilt by joins.

An archive is two tables under one path. `payloads` holds each distinct payload once, addressed by its SHA-256;
`records` holds the exact bytes of every record's headers (the WARC header and, of captures, the HTTP header) with the
address of the payload that follows them, null where none does. A record is its headers, its payload and two line
ends, and comes back byte for byte by a join on the address. The address is verified on both ways: payloads of one
address must agree in length and SHA-1 when they are stored, and must give their address again when they are read.

Captures: the first record of a payload (by smallest id) is a response, later ones are revisits, which refer to it and
carry no payload. Records with payloads below `least` bytes are all responses. A null payload is an empty one. A null id comes
after all others and can't be referred to: where no id of a payload is known, all its records are responses. Records
that repeat the smallest id are all responses. Control characters and spaces of a URI are percent-encoded, a null URI
is `about:blank`. An empty table gives an archive without records.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.llm.common import collected, shared_path, whole_ids, written

# Version line, line end, revisit profile and the base32 alphabet of the format.
VERSION = "WARC/1.1"
END = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: Record ids are URIs that end with the row's id.
RECORD_ID = "urn:x-record:"
BLANK = END + END


def base32_sha1(data: Column) -> Column:
    """SHA-1 of a binary as upper-case base32; its 160 bits need no padding."""
    fives = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.conv(F.substr(F.sha1(data), k * 5 + 1, F.lit(5)), 16, 10).cast("int"))
    four = lambda v: F.concat(*[F.substr(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)])
    return F.array_join(F.transform(fives, four), "")


def _uri(url: Column) -> Column:
    """A URI that stays on one header line; characters from the blank downwards and DEL become percent escapes."""
    codes = [*range(33), 127]
    out = F.coalesce(url, F.lit("about:blank"))
    return F.when(out.rlike(r"[\x00-\x20\x7F]"), _replaced(out, {chr(c): f"%{c:02X}" for c in codes})).otherwise(out)


def _replaced(text: Column, table: dict[str, str]) -> Column:
    for a, b in table.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def captures(rows: DataFrame, key: str, url: str, body: str, date: str = "2020-01-01T00:00:00Z", least: int = 0) -> tuple[DataFrame, DataFrame]:
    """The records of a table of pages: (record, headers, address, length) and, to be stored, (address, payload).

    record is the row's id, length that of the whole payload; revisits have a null address.
    """
    whole_ids(rows, key)
    payload = F.coalesce(F.col(body).cast("binary"), F.lit(b""))
    addressed = rows.select(F.col(key).cast("long").alias("record"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    facts = written(addressed.select("record", "url", F.sha2("payload", 256).alias("address"), base32_sha1(F.col("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("length")), "facts")
    # written first, so that the join below may split the address that most rows share
    first = written(facts.groupBy("address").agg(F.min("record").alias("first")), "first")
    own = facts.join(first, "address")
    again = (F.col("length") >= least) & F.col("first").isNotNull() & ~F.col("record").eqNullSafe(F.col("first"))
    return own.select("record", _headers(again, date).alias("headers"), F.when(~again, F.col("address")).alias("address"), "length"), addressed.select(F.sha2("payload", 256).alias("address"), "payload")


def _name(record: Column) -> Column:
    return F.concat(F.lit(f"<{RECORD_ID}"), F.coalesce(record.cast("string"), F.lit("none")), F.lit(">"))


def _headers(again: Column, date: str) -> Column:
    """The exact headers of a capture: those of the record, a blank line, those of the HTTP response, a blank line."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(END))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}"), line("Content-Length", F.col("length").cast("string")), F.lit(END))
    content = F.octet_length(http) + F.when(again, F.lit(0)).otherwise(F.col("length"))
    return F.concat(
        F.lit(VERSION + END), line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))), line("WARC-Record-ID", _name(F.col("record"))), line("WARC-Date", F.lit(date)), line("WARC-Target-URI", _uri(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))), F.when(again, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _name(F.col("first"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", content.cast("string")), F.lit(END), http,
    ).cast("binary")


def store(records: DataFrame, payloads: DataFrame, path: str) -> None:
    """Write an archive: records (record, headers, address) and payloads (address, payload), in any number of copies.

    Copies are reduced to one in each task before they are shuffled. Payloads of one address that differ raise an error.
    """
    checked = payloads.where("address is not null").withColumn("_mark", F.struct(F.octet_length("payload").alias("n"), F.sha1("payload").alias("h")))
    once = checked.groupBy("address").agg(F.first("payload").alias("payload"), F.min("_mark").alias("_low"), F.max("_mark").alias("_high"))
    same = F.when(F.col("_low") == F.col("_high"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payloads differ at address "), F.col("address"))).cast("binary"))
    once.select("address", same.alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")
    records.select("record", "headers", "address").write.option("compression", "zstd").parquet(f"{path}/records")


def restored(spark: SparkSession, path: str) -> DataFrame:
    """(record, content): all records of an archive, byte for byte, without the line ends that part records in a file.

    A payload that doesn't give its address, or that is missing, raises an error.
    """
    records = spark.read.schema("record long, headers binary, address string").parquet(f"{path}/records")
    kept = spark.read.schema("address string, payload binary").parquet(f"{path}/payloads")
    right = F.sha2("payload", 256) == F.col("address")
    whole = F.when(F.coalesce(right, F.lit(False)), F.concat("headers", "payload")).otherwise(F.raise_error(F.concat(F.lit("no payload at address "), F.col("address"))).cast("binary"))
    alone = records.where("address is null").select("record", F.col("headers").alias("content"))
    return records.where("address is not null").join(kept, "address", "left").select("record", whole.alias("content")).unionByName(alone)


def parsed(records: DataFrame, content: str = "content") -> DataFrame:
    """The records' fields, read from their bytes alone: type, id, target, date, digest, refers_to, block and payload.

    The block ends after Content-Length bytes; a shorter record raises an error. The payload is what follows the HTTP
    header of the block. Header names are matched in any case.
    """
    raw = F.col(content)
    head = F.substring_index(raw.cast("string"), BLANK, 1)
    field = lambda name: F.nullif(F.regexp_extract("_head", rf"(?im)^{name}:[ \t]*(.*?)[ \t]*\r?$", 1), F.lit(""))
    own = records.withColumn("_head", head).withColumn("_from", F.octet_length("_head") + len(BLANK) + 1).withColumn("_n", field("Content-Length").cast("int"))
    short = (F.octet_length(raw) - F.col("_from") + 1 < F.col("_n")) | F.col("_n").isNull()
    block = F.when(short, F.raise_error(F.lit("a record is shorter than it says")).cast("binary")).otherwise(F.substr(raw, F.col("_from"), F.col("_n")))
    fields = {"type": "WARC-Type", "id": "WARC-Record-ID", "target": "WARC-Target-URI", "date": "WARC-Date", "digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
    got = own.withColumn("block", block).withColumns({c: field(name) for c, name in fields.items()})
    http = F.octet_length(F.substring_index(F.col("block").cast("string"), BLANK, 1)) + len(BLANK)
    return got.withColumn("payload", F.substr("block", http + 1, F.octet_length("block"))).drop("_head", "_from", "_n")


def export(spark: SparkSession, path: str, files: str, most: int = 100_000) -> None:
    """Write an archive's records as ordinary gzipped WARC files of at most `most` records each.

    Two line ends part records in such a file, so Spark's text writer gives exact files of them.
    """
    lines = restored(spark, path).select(F.col("content").cast("string").alias("value"))
    lines.write.option("lineSep", BLANK).option("compression", "gzip").option("maxRecordsPerFile", most).text(files)


def imported(spark: SparkSession, files: str) -> tuple[DataFrame, DataFrame]:
    """Records and payloads, as store() takes them, of WARC files, plain or gzipped; a file is read by one task.

    Records are numbered by file and place. Headers are kept as they are, HTTP headers of responses among them.
    """
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                at, place = 0, 0
                while at < len(data):
                    end = data.index(b"\r\n\r\n", at) + 4
                    head = data[at:end].decode("utf-8", "replace")
                    n = next(int(x.split(":", 1)[1]) for x in head.split(END) if x.lower().startswith("content-length:"))
                    cut = end
                    if "application/http" in head and (gap := data.find(b"\r\n\r\n", end, end + n)) >= 0:
                        cut = gap + 4
                    yield pa.RecordBatch.from_pydict({"file": [path], "place": [place], "headers": [data[at:cut]], "payload": [data[cut : end + n]]}, schema=shape)
                    at, place = end + n + 4, place + 1

    shape = pa.schema([("file", pa.string()), ("place", pa.int64()), ("headers", pa.binary()), ("payload", pa.binary())])
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(files).select("path", "content")
    rows = found.mapInArrow(split, "file string, place long, headers binary, payload binary")
    address = F.when(F.octet_length("payload") > 0, F.sha2("payload", 256))
    numbered = rows.withColumn("record", F.xxhash64("file", "place")).withColumn("address", address)
    return numbered.select("record", "headers", "address"), numbered.select("address", "payload")


def _number(name: Column) -> Column:
    return F.regexp_extract(name, rf"^<{RECORD_ID}(-?\d+)>$", 1).try_cast("long")


def archived(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html", least: int = 0) -> DataFrame:
    """Write an archive of the pages, read it back and give each record's id, payload, type and what it refers to.

    A revisit's payload is that of the response that it refers to, whose digest is its own.
    """
    spark = pages.sparkSession
    path = shared_path(spark, "archive")
    records, payloads = captures(pages, key, url, body, least=least)
    store(records, payloads, path)
    collected(spark)
    fields = parsed(restored(spark, path))
    response = F.col("type") == "response"
    read = written(fields.select(
        _number(F.col("id")).alias("page_id"), F.when(response, F.octet_length("payload").cast("long")).alias("payload_bytes"), F.when(response, base32_sha1(F.col("payload"))).alias("payload_digest"),
        F.col("type").alias("record_type"), _number(F.col("refers_to")).alias("refers_to"), F.regexp_replace("digest", "^sha1:", "").alias("said"),
    ), "read")
    own = read.where("record_type = 'response'")
    whole = F.when(F.col("payload_digest") == F.col("said"), F.col("payload_bytes")).otherwise(F.raise_error(F.lit("a payload's digest is not that of its header")).cast("long"))
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    responses = own.withColumn("payload_bytes", whole).select(*names)
    # written first, so that the response that most revisits refer to may be split
    targets = written(own.select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("said"), "payload_bytes").where("refers_to is not null").distinct(), "targets")
    revisits = read.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest").join(targets, ["refers_to", "said"], "left").withColumn("payload_digest", F.col("said"))
    known = F.when(F.col("payload_bytes").isNotNull(), F.col("payload_bytes")).otherwise(F.raise_error(F.lit("a revisit refers to no response")).cast("long"))
    out = responses.unionByName(revisits.withColumn("payload_bytes", known).select(*names))
    return out.withColumnRenamed("page_id", key)


def oracle() -> str:
    bits = "('0x' || substr(h, 5 * k + 1, 5))::bigint"
    return f"""
with p as (select page_id, coalesce(html, '') as body from pages),
q as (select page_id, strlen(body)::bigint as n, sha1(body) as h, sha256(body) as a from p),
w as (select *, min(page_id) over (partition by a) as first from q)
select page_id, n as payload_bytes,
  array_to_string(list_transform(range(0, 8), lambda k: {' || '.join(f"substr('{BASE32}', ({bits} >> {s} & 31)::bigint + 1, 1)" for s in (15, 10, 5, 0))}), '') as payload_digest,
  case when first is null or page_id is not distinct from first then 'response' else 'revisit' end as record_type,
  case when first is not null and page_id is distinct from first then first end as refers_to from w"""
