"""The archive: records byte for byte, what is a revisit, odd rows, damaged archives, ordinary files."""

from __future__ import annotations

import base64
import gzip
import hashlib

import pytest

from lineweave.llm import warc

SCHEMA = "page_id long, url string, html string"
PAGES = [
    (5, "http://a/x", "<p>one</p>"), (2, "http://a/y z\n", "<p>one</p>"), (9, None, "<p>one</p>"), (3, "http://b", ""), (4, "http://b", None), (1, "", "ü\r\n\r\nWARC/1.1\r\nContent-Length: 7\r\n"),
    (None, "http://n", "<p>one</p>"), (None, "http://n", "alone"), (7, "u", "twice"), (7, "v", "twice"), (8, "w", "twice"), (6, "long", "x" * 3_000_000), (7, "u", "other"), (10, "u", "other"),
]


def digest(body):
    return base64.b32encode(hashlib.sha1(body).digest()).decode()


def plain(pages, least=0):
    first = {}
    for k, _, body in pages:
        if k is not None:
            first[body or ""] = min(k, first.get(body or "", k))
    out = []
    for k, _, body in pages:
        b, f = (body or "").encode(), first.get(body or "")
        again = len(b) >= least and f is not None and k != f
        out.append((k, len(b), digest(b), "revisit" if again else "response", f if again else None))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r[0] or 0, r[2]))


@pytest.mark.parametrize("least", [0, 6, 100])
def test_pages(spark, least):
    pages = spark.createDataFrame(PAGES, SCHEMA).selectExpr("html", "url", "page_id", "1 as record", "2 as address", "3 as payload").repartition(3)
    assert ordered(warc.archived(pages, least=least).collect()) == ordered(plain(PAGES, least))


def test_empty(spark):
    assert warc.archived(spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(TypeError):
        warc.archived(spark.createDataFrame([("a", "u", "h")], "page_id string, url string, html string"))


def stored(spark, path, pages=PAGES):
    records, payloads = warc.captures(spark.createDataFrame(pages, SCHEMA), "page_id", "url", "html")
    warc.store(records, payloads, path)


def test_records_are_exact_and_payloads_are_kept_once(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    stored(spark, path)
    kept = spark.read.parquet(f"{path}/payloads").collect()
    assert sorted(bytes(r.payload) for r in kept) == sorted({(x[2] or "").encode() for x in PAGES}) and all(hashlib.sha256(r.payload).hexdigest() == r.address for r in kept)
    by = {r.record: bytes(r.content) for r in warc.restored(spark, path).collect() if r.record}
    assert by[2] == (
        b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-record:2>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nWARC-Target-URI: http://a/y%20z%0A\r\nWARC-Payload-Digest: sha1:" + digest(b"<p>one</p>").encode()
        + b"\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: 89\r\n\r\nHTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: 10\r\n\r\n<p>one</p>"
    )
    assert b"WARC-Refers-To: <urn:x-record:2>\r\n" in by[5] and by[5].endswith(b"\r\n\r\n") and b"one" not in by[5]


def test_files(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    stored(spark, path)
    want = sorted(bytes(r.content) for r in warc.restored(spark, path).collect())
    warc.export(spark, path, f"file://{tmp_path}/files", most=3)
    parts = list((tmp_path / "files").glob("part-*.gz"))
    assert len(parts) >= 5 and b"".join(sorted(gzip.decompress(p.read_bytes())[:9] for p in parts)) == b"WARC/1.1\r" * len(parts)
    # files read back give the same records again, gzipped or not
    (tmp_path / "plain").mkdir()
    for k, p in enumerate(parts):
        (tmp_path / "plain" / f"{k}.warc").write_bytes(gzip.decompress(p.read_bytes()))
    for k, files in enumerate((f"file://{tmp_path}/files", f"file://{tmp_path}/plain")):
        warc.store(*warc.imported(spark, files), f"{path}{k}")
        assert sorted(bytes(r.content) for r in warc.restored(spark, f"{path}{k}").collect()) == want
        assert spark.read.parquet(f"{path}{k}/payloads").count() == len({x[2] or "" for x in PAGES}) - 1  # the empty one isn't kept


def test_damage_is_seen(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    stored(spark, path)
    kept = spark.read.parquet(f"{path}/payloads")
    kept.selectExpr("address", "case when length(payload) = 5 then cast('other' as binary) else payload end as payload").write.parquet(f"{path}/changed/payloads")
    spark.read.parquet(f"{path}/records").write.parquet(f"{path}/changed/records")
    with pytest.raises(Exception, match="no payload at address"):
        warc.restored(spark, f"{path}/changed").collect()
    with pytest.raises(Exception, match="differ at address"):
        warc.store(spark.createDataFrame([], "record long, headers binary, address string"), spark.createDataFrame([("a", b"1"), ("a", b"2")], "address string, payload binary"), f"{path}/two")
    short = spark.createDataFrame([(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc",)], "content binary")
    with pytest.raises(Exception, match="shorter than it says"):
        warc.parsed(short).collect()
