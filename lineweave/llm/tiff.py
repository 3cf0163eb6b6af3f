"""TIFF media columns: one row per page of each file, read from the bytes of a binary column.

The reader walks the chain of image directories (classic and big files, either byte order), decodes PackBits, LZW or
deflate strips and tiles, undoes horizontal and floating-point predictors and hands on the samples. A small writer
stores payloads as grey images for tests and round trips.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.llm.common import buffers, flat, steps

# Fixed values of the format: bytes of each field type, and the tags that are read.
_TYPE = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, FILL_ORDER = 256, 257, 258, 259, 262, 266
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 322, 323, 324, 325
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
_CLEAR, _END, _FIRST = 256, 257, 258


class TiffError(ValueError):
    pass


@dataclass(frozen=True)
class Page:
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    tiled: bool
    pixels: bytes  # rows of pixels of samples; 1, 2 and 4 bits as a byte each, wider ones little-endian


# ---- codecs ----


def packbits_decode(data: bytes, need: int | None = None) -> bytes:
    """The decoded bytes; with need it stops once it has so many."""
    out, i, n, size = [], 0, len(data), 0
    while i < n and (need is None or size < need):
        k = data[i]
        size += k + 1 if k < 128 else 257 - k if k > 128 else 0
        if k < 128:
            out.append(data[i + 1 : i + 2 + k])
            i += k + 2
        elif k > 128:
            out.append(data[i + 1 : i + 2] * (257 - k))
            i += 2
        else:
            i += 1
    return b"".join(out)


def packbits_encode(data: bytes) -> bytes:
    """Runs of three or more equal bytes as runs, all else as literals."""
    x = np.frombuffer(data, np.uint8)
    if not len(x):
        return b""
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    size = np.diff(np.append(first, len(x)))
    out, at = [], 0
    for f, s in zip(first[size >= 3].tolist(), size[size >= 3].tolist(), strict=True):
        out += [bytes([min(128, f - a) - 1]) + data[a : min(a + 128, f)] for a in range(at, f, 128)]
        while s:
            k = min(128, s)
            out.append(bytes([257 - k if k > 1 else 0, data[f]]))
            s -= k
        at = f + int(size[np.searchsorted(first, f)])
    out += [bytes([min(128, len(data) - a) - 1]) + data[a : a + 128] for a in range(at, len(data), 128)]
    return b"".join(out)


#: Width of the k-th code after a clear: it grows one code before the table fills a power of two.
_WIDTHS = np.array([9 if k < 254 else 10 if k < 766 else 11 if k < 1790 else 12 for k in range(4096)], np.int64)


def lzw_decode(data: bytes, expected: int) -> bytes:
    raw = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.int64)
    bits, at, out, size = len(data) * 8, 0, [], 0
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    while size < expected:
        start = at + np.concatenate([[0], np.cumsum(_WIDTHS)[:-1]])
        start = start[start + _WIDTHS <= bits]
        if not len(start):
            break
        width, k = _WIDTHS[: len(start)], start >> 3
        window = (raw[k] << 16) | (raw[k + 1] << 8) | raw[k + 2]
        codes = (window >> (24 - (start & 7) - width)) & ((1 << width) - 1)
        stop = np.flatnonzero((codes == _CLEAR) | (codes == _END))
        n = int(stop[0]) if len(stop) else len(codes)
        table, last = base.copy(), b""
        for code in codes[:n].tolist():
            if not last:
                if code > 255:
                    raise TiffError("LZW code before the first byte")
                entry = table[code]
            else:
                if code < len(table):
                    entry = table[code]
                elif code == len(table):
                    entry = last + last[:1]
                else:
                    raise TiffError("LZW code beyond the table")
                table.append(last + entry[:1])
            out.append(entry)
            size += len(entry)
            last = entry
        if not len(stop) or codes[n] == _END:
            break
        at = int(start[n] + width[n])
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    codes, widths, table, k, w = [_CLEAR], [9], {}, 0, -1
    for c in data:
        if w < 0:
            w = c
            continue
        if (x := table.get(w << 8 | c)) is not None:
            w = x
            continue
        codes.append(w)
        widths.append(k)
        table[w << 8 | c] = _FIRST + k
        k += 1
        w = c
        if k == 3836:  # the table is full but for what the last width can say
            codes.append(_CLEAR)
            widths.append(k)
            table.clear()
            k = 0
    if w >= 0:
        codes.append(w)
        widths.append(k)
        k += 1
    codes.append(_END)
    widths.append(k)
    width = _WIDTHS[np.array([0, *widths[1:]])]
    x = np.unpackbits(np.array(codes, ">u2").view(np.uint8)).reshape(-1, 16)
    return np.packbits(x[np.arange(16) >= 16 - width[:, None]]).tobytes()


def _inflate(data: bytes, need: int) -> bytes:
    return zlib.decompressobj().decompress(data, max(need, 1))


# ---- reader ----


def _directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        raise TiffError("no TIFF header")
    magic = struct.unpack_from(order + "H", data, 2)[0]
    if magic not in (42, 43):
        raise TiffError("no TIFF header")
    big = magic == 43
    at, seen = struct.unpack_from(order + ("Q" if big else "I"), data, 8 if big else 4)[0], set()
    while at:
        if at in seen:
            raise TiffError("the directories form a cycle")
        seen.add(at)
        n = struct.unpack_from(order + ("Q" if big else "H"), data, at)[0]
        at += 8 if big else 2
        tags = {}
        for _ in range(n):
            tag, kind, count = struct.unpack_from(order + ("HHQ" if big else "HHI"), data, at)
            if kind in _TYPE:
                form = f"{order}{count}{_TYPE[kind]}"
                inline = struct.calcsize(form) <= (8 if big else 4)
                value_at = at + (12 if big else 8)
                if not inline:
                    value_at = struct.unpack_from(order + ("Q" if big else "I"), data, value_at)[0]
                tags[tag] = struct.unpack_from(form, data, value_at)
            at += 20 if big else 12
        yield order, tags
        at = struct.unpack_from(order + ("Q" if big else "I"), data, at)[0]


def _samples(raw: bytes, order: str, bits: int, rows: int, width: int, samples: int, predictor: int) -> np.ndarray:
    """rows x width x samples of one strip or tile, predictor undone."""
    if bits < 8:
        line = -(-width * samples * bits // 8)
        x = np.unpackbits(np.frombuffer(raw[: line * rows].ljust(line * rows, b"\0"), np.uint8)).reshape(rows, -1)
        x = x[:, : width * samples * bits].reshape(rows, -1, bits)
        return (x * (1 << np.arange(bits - 1, -1, -1))).sum(2).astype(np.uint8).reshape(rows, width, samples)
    size = bits // 8
    need = rows * width * samples * size
    raw = raw[:need].ljust(need, b"\0")
    if predictor == 3:
        x = np.cumsum(np.frombuffer(raw, np.uint8).reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, size, width * samples)
        return x.transpose(0, 2, 1)[:, :, ::-1].copy().view(f"<u{size}").reshape(rows, width, samples)
    x = np.frombuffer(raw, f"{order}u{size}").reshape(rows, width, samples).astype(f"<u{size}")
    return np.cumsum(x, axis=1, dtype=x.dtype) if predictor == 2 else x


def pages(data: bytes) -> Iterator[Page]:
    """All pages of a file, in the order of its directories; TiffError where the file is broken."""
    try:
        for order, t in _directories(data):
            width, height = t[WIDTH][0], t[HEIGHT][0]
            samples, bits = t.get(SAMPLES, (1,))[0], t.get(BITS, (1,))[0]
            compression, predictor = t.get(COMPRESSION, (1,))[0], t.get(PREDICTOR, (1,))[0]
            if bits not in (1, 2, 4, 8, 16, 32, 64) or len(set(t.get(BITS, (1,)))) > 1:
                raise TiffError(f"samples of {t.get(BITS)} bits")
            planes = samples if t.get(PLANAR, (1,))[0] == 2 and samples > 1 else 1
            deep, tiled = samples // planes, TILE_OFFSETS in t
            if tiled:
                w, h, offsets, sizes = t[TILE_WIDTH][0], t[TILE_HEIGHT][0], t[TILE_OFFSETS], t[TILE_BYTES]
            else:
                w, h = width, min(t.get(ROWS_PER_STRIP, (height,))[0], height)
                offsets, sizes = t[STRIP_OFFSETS], t.get(STRIP_BYTES, (len(data),))
            across, down = -(-width // max(w, 1)), -(-height // max(h, 1))
            if len(offsets) < across * down * planes:
                raise TiffError("blocks are missing")
            image = np.zeros((height, width, samples), f"<u{max(bits, 8) // 8}")
            for k in range(across * down * planes):
                plane, block = divmod(k, across * down)
                y, x = block // across * h, block % across * w
                rows = h if tiled else min(h, height - y)
                raw = data[offsets[k] : offsets[k] + sizes[k]]
                if len(raw) < sizes[k] and STRIP_BYTES in t | {TILE_BYTES: 0}:
                    raise TiffError("the file ends within a block")
                if t.get(FILL_ORDER, (1,))[0] == 2:
                    raw = np.packbits(np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, 8)[:, ::-1]).tobytes()
                need = rows * -(-w * deep * bits // 8)
                if compression == PACKBITS:
                    raw = packbits_decode(raw, need)
                elif compression == LZW:
                    raw = lzw_decode(raw, need)
                elif compression in (DEFLATE, OLD_DEFLATE):
                    raw = _inflate(raw, need)
                elif compression != NONE:
                    raise TiffError(f"compression {compression}")
                if len(raw) < need:
                    raise TiffError("a block decodes to too few bytes")
                part = _samples(raw, order, bits, rows, w, deep, predictor)
                part = part[: height - y, : width - x]
                image[y : y + part.shape[0], x : x + part.shape[1], plane * deep : (plane + 1) * deep] = part
            yield Page(width, height, samples, bits, compression, predictor, tiled, image.tobytes())
    except (struct.error, KeyError, zlib.error, IndexError, ValueError, MemoryError) as e:
        raise e if isinstance(e, TiffError) else TiffError(f"{type(e).__name__}: {e}") from e


# ---- writer ----


def write(payload: bytes, width: int = 64, page_rows: int = 1024) -> bytes:
    """Grey 8-bit pages of `width` columns that hold the payload (a positive multiple of width) row by row.

    The layout depends on the payload alone: its checksum picks the byte order, strips or tiles, predictor and
    compression of each page, so that equal payloads are stored alike and all of the reader's paths are in use.
    """
    seed = zlib.crc32(payload)
    order, links = "<" if seed & 1 else ">", 4
    out = bytearray((b"II" if seed & 1 else b"MM") + struct.pack(order + "HI", 42, 0))
    step = width * page_rows
    for k in range(0, len(payload), step):
        image = np.frombuffer(payload[k : k + step], np.uint8).reshape(-1, width)
        kind = (PACKBITS, LZW, DEFLATE, DEFLATE)[(seed >> 1) + k // step & 3]
        tiled, predictor = bool(seed >> 4 & 1), 2 if kind != PACKBITS and seed >> 5 & 1 else 1
        rows = 64 if tiled else 256
        blocks = []
        for y in range(0, len(image), rows):
            part = image[y : y + rows]
            if tiled and len(part) < rows:
                part = np.concatenate([part, np.zeros((rows - len(part), width), np.uint8)])
            if predictor == 2:
                part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
            raw = part.tobytes()
            blocks.append(packbits_encode(raw) if kind == PACKBITS else lzw_encode(raw) if kind == LZW else zlib.compress(raw, 6))
        offsets = []
        for b in blocks:
            offsets.append(len(out))
            out += b + b"\0" * (len(b) & 1)
        tags: list[tuple[int, int, list[int]]] = [(WIDTH, 3, [width]), (HEIGHT, 4, [len(image)]), (BITS, 3, [8]), (COMPRESSION, 3, [kind]), (PHOTOMETRIC, 3, [1])]
        sizes = [len(b) for b in blocks]
        if tiled:
            tags += [(SAMPLES, 3, [1]), (PREDICTOR, 3, [predictor]), (TILE_WIDTH, 3, [width]), (TILE_HEIGHT, 3, [rows]), (TILE_OFFSETS, 4, offsets), (TILE_BYTES, 4, sizes)]
        else:
            tags += [(STRIP_OFFSETS, 4, offsets), (SAMPLES, 3, [1]), (ROWS_PER_STRIP, 4, [rows]), (STRIP_BYTES, 4, sizes), (PREDICTOR, 3, [predictor])]
        extra, entries, at = b"", b"", len(out)
        extra_at = at + 2 + 12 * len(tags) + 4
        for tag, form, values in tags:
            raw = struct.pack(f"{order}{len(values)}{'H' if form == 3 else 'I'}", *values)
            entries += struct.pack(order + "HHI", tag, form, len(values))
            if len(raw) <= 4:
                entries += raw.ljust(4, b"\0")
            else:
                entries += struct.pack(order + "I", extra_at + len(extra))
                extra += raw
        out += struct.pack(order + "H", len(tags)) + entries + struct.pack(order + "I", 0) + extra
        struct.pack_into(order + "I", out, links, at)  # the page before, or the header, leads here
        links = extra_at - 4
    return bytes(out)


# ---- DataFrames ----


def store(docs: DataFrame, key: str = "doc_id", text_col: str = "text", unit: int = 64) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes and media, a TIFF that holds the text's UTF-8 bytes.

    A null text counts as empty. Zero bytes pad the payload to a positive multiple of `unit`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffers(batch.column(1))
            for lo, hi in steps(off):
                media = []
                for i in range(lo, hi):
                    raw = data[off[i] : off[i + 1]].tobytes()
                    media.append(write(raw + b"\0" * (-len(raw) % unit or (0 if raw else unit)), unit))
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), flat(np.diff(off)[lo:hi], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(key), F.col(text_col).cast("string")).mapInArrow(run, f"doc_id {docs.schema[key].dataType.simpleString()}, n_bytes long, media binary")


_PAGE = "page int, n_pages int, width long, height long, samples int, bits int, compression int, predictor int, tiled boolean, pixels binary, total_bytes long, total_sha256 string, histogram string, error string"


def tiff_pages(files: DataFrame, key: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per page of each file: the key, page (from 0), n_pages (up to and with this one), geometry and pixels.

    total_bytes, total_sha256 and histogram (of sixteen ranges of byte values, each a share of 255 in hexadecimal)
    cover the pixels of all pages up to this one, so the row with last = true has those of the whole file. A null or
    empty file, and one that breaks off, has a last row with page null and an error; its earlier pages stay. Only the
    two named columns are read; repeated rows each get their pages.
    """

    def rows(blob: bytes) -> list[tuple]:
        out, digest, n, total, bins = [], hashlib.sha256(), 0, 0, np.zeros(16, np.int64)
        try:
            if not blob:
                raise TiffError("no file")
            for n, p in enumerate(pages(blob), 1):
                digest.update(p.pixels)
                total += len(p.pixels)
                bins += np.bincount(np.frombuffer(p.pixels, np.uint8) >> 4, minlength=16)
                text = bytes((bins * 255 // max(total, 1)).astype(np.uint8)).hex()
                out.append((n - 1, n, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.tiled, p.pixels, total, digest.hexdigest(), text, None))
        except TiffError as e:
            out.append((None, n, *[None] * 7, None, total, digest.hexdigest(), None, str(e)))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.bool_(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            data, off = buffers(batch.column(1))
            for lo, hi in steps(off):
                found, at, last = [], [], []
                for i in range(lo, hi):
                    own = rows(data[off[i] : off[i + 1]].tobytes())
                    found += own
                    at += [i] * len(own)
                    last += [False] * (len(own) - 1) + [True]
                columns = [pa.array(c, kind) for c, kind in zip(zip(*found, strict=True), schema, strict=True)]
                yield pa.record_batch([batch.column(0).take(flat(at, pa.int64())), *columns, flat(last, pa.bool_())], names=["doc_id", *[x.split()[0] for x in _PAGE.split(", ")], "last"])

    return files.select(F.col(key), F.col(media_col)).mapInArrow(run, f"doc_id {files.schema[key].dataType.simpleString()}, {_PAGE}, last boolean")


def media_digests(docs: DataFrame) -> DataFrame:
    """Store each text as TIFF, read all pages back, and give sizes, digests and a feature of what was read."""
    stored = store(docs)
    packed = stored.select(F.struct("doc_id", "n_bytes", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256")).alias("own"), "media")
    read = tiff_pages(packed, "own", "media").where("last")
    return read.select(
        "doc_id.doc_id",
        "doc_id.n_bytes",
        F.col("total_bytes").alias("payload_bytes"),
        F.col("total_sha256").alias("payload_sha256"),
        F.crc32(F.expr("substring(pixels, -64, 64)")).alias("tail_crc32"),
        "doc_id.media_bytes",
        "doc_id.media_sha256",
        F.format_string("h16:%s", "histogram").alias("feature"),
        "n_pages",
        "error",
    )
