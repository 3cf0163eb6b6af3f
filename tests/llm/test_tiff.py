"""TIFF pages: codecs, predictors, layouts, and the round trip of texts."""

from __future__ import annotations

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from lineweave.llm import tiff


def test_codecs():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 127, 128, 129, 300, 5000, 30000):
        for data in (bytes(rng.randrange(256) for _ in range(n)), bytes(rng.choice(b"aab") for _ in range(n)), b"x" * n):
            assert tiff.packbits_decode(tiff.packbits_encode(data)) == data
            assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data
    # fixed values: the worked example of the format's description
    assert tiff.packbits_decode(bytes.fromhex("FE AA 02 80 00 2A FD AA 03 80 00 2A 22 F7 AA")) == bytes.fromhex("AA AA AA 80 00 2A AA AA AA AA 80 00 2A 22 AA AA AA AA AA AA AA AA AA AA")


def image(order, tags, blocks, at_tag, big=False):
    """One directory with the given blocks, for layouts that the writer doesn't use."""
    head = (b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, 0) if big else struct.pack(order + "HI", 42, 0))
    body, offsets = head, []
    for b in blocks:
        offsets.append(len(body))
        body += b
    tags = sorted([*tags, (at_tag, 4, offsets), (279 if at_tag == 273 else 325, 4, [len(b) for b in blocks])])
    directory, size, room = len(body), (20 if big else 12), (8 if big else 4)
    extra_at = directory + (8 if big else 2) + size * len(tags) + room
    entries, extra = struct.pack(order + ("Q" if big else "H"), len(tags)), b""
    for tag, kind, values in tags:
        raw = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
        value = raw.ljust(room, b"\0") if len(raw) <= room else struct.pack(order + ("Q" if big else "I"), extra_at + len(extra))
        extra += raw if len(raw) > room else b""
        entries += struct.pack(order + ("HHQ" if big else "HHI"), tag, kind, len(values)) + value
    body += entries + struct.pack(order + ("Q" if big else "I"), 0) + extra
    return body[:8] + struct.pack(order + "Q", directory) + body[16:] if big else body[:4] + struct.pack(order + "I", directory) + body[8:]


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("big", [False, True])
def test_layouts(order, big):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 65536, (10, 7, 3)).astype("<u2")
    diff = np.diff(np.concatenate([np.zeros((10, 1, 3), "<u2"), x], 1), axis=1).astype(order + "u2")
    strips = [zlib.compress(diff[k : k + 4].tobytes()) for k in (0, 4, 8)]
    tags = [(256, 3, [7]), (257, 3, [10]), (258, 3, [16] * 3), (259, 3, [8]), (277, 3, [3]), (278, 3, [4]), (317, 3, [2])]
    (page,) = tiff.pages(image(order, tags, strips, 273, big))
    assert page.pixels == x.tobytes() and (page.width, page.height, page.samples, page.bits) == (7, 10, 3, 16)
    planes = [tiff.lzw_encode(np.ascontiguousarray(x[:, :, k].astype("u1")).tobytes()) for k in range(3)]
    tags = [(256, 3, [7]), (257, 3, [10]), (258, 3, [8] * 3), (259, 3, [5]), (277, 3, [3]), (278, 3, [10]), (284, 3, [2])]
    (page,) = tiff.pages(image(order, tags, planes, 273, big))
    assert page.pixels == x.astype("u1").tobytes()
    bits = rng.integers(0, 2, (5, 11)).astype("u1")
    tags = [(256, 3, [11]), (257, 3, [5]), (258, 3, [1]), (259, 3, [32773]), (278, 3, [5])]
    (page,) = tiff.pages(image(order, tags, [tiff.packbits_encode(np.packbits(bits, axis=1).tobytes())], 273, big))
    assert page.pixels == bits.tobytes()
    f = rng.random((4, 6)).astype("<f4")
    planes_of = f.view("u1").reshape(4, 6, 4)[:, :, ::-1].transpose(0, 2, 1).reshape(4, 24)
    delta = np.concatenate([planes_of[:, :1], np.diff(planes_of, axis=1)], 1)
    tags = [(256, 3, [6]), (257, 3, [4]), (258, 3, [32]), (259, 3, [8]), (278, 3, [4]), (317, 3, [3]), (339, 3, [3])]
    (page,) = tiff.pages(image(order, tags, [zlib.compress(delta.astype("u1").tobytes())], 273, big))
    assert page.pixels == f.tobytes()


def test_broken_files():
    good = tiff.write(b"payload" * 64)
    for bad in (b"", b"II", b"II*\0\xff\xff\xff\x7f", good[: len(good) // 2], b"MM\0*\0\0\0\x08\0\0\0\0\0\x08", good[:8] + b"\xff" * (len(good) - 8)):
        with pytest.raises(tiff.TiffError):
            list(tiff.pages(bad))
            raise tiff.TiffError("no page")


def test_texts(spark):
    rows = [(1, "Hello TIFF"), (2, None), (3, ""), (4, "é" * 32), (5, "long text " * 20000), (6, "x" * 64), (6, "x" * 64)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as page", "2 as media", "3 as own")
    got = tiff.media_digests(df).collect()
    assert len(got) == len(rows)
    for r in got:
        raw = (dict(rows)[r.doc_id] or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload)) and r.error is None
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        media = tiff.write(payload)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert {r.doc_id: r.n_pages for r in got}[5] == 4
    assert tiff.media_digests(df.limit(0)).collect() == []


def test_pages_of_files(spark):
    files = spark.createDataFrame([(1, bytearray(tiff.write(bytes(range(64)) * 3000))), (2, bytearray(b"junk")), (3, None)], "doc_id long, media binary")
    got = tiff.tiff_pages(files).collect()
    first = [r for r in got if r.doc_id == 1]
    assert [r.page for r in first] == [0, 1, 2] and b"".join(bytes(r.pixels) for r in first) == bytes(range(64)) * 3000 and [r.last for r in first] == [False, False, True]
    assert all(r.page is None and r.error and r.last for r in got if r.doc_id != 1)
