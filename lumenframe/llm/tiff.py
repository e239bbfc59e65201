"""TIFF media columns: a reader that gives a row per page, and a writer to store bytes as 8-bit grey pages.

The reader walks the chain of image directories in either byte order, fetches the strips or tiles of each page, decodes them (none,
PackBits, LZW, deflate), undoes the horizontal or the floating-point predictor, and joins them into the page's samples. Samples have 1, 2, 4, 8, 16, 32
or 64 bits (those of fewer than 8 become bytes), interleaved or in planes.

Defined cases: a null text counts as empty; empty payloads are 64 zero bytes; texts of any length become pages of at most PAGE_ROWS rows; equal texts
give equal files; a null medium gives no page rows; a page that can't be decoded gives a row with its number and the reason in `error`, and the
other pages theirs; a medium without a readable directory gives one row with page null; a directory chain that runs in a circle ends where it closes, one
that breaks off ends there, with a row for the break; repeated rows are treated one by one; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
_KINDS = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}

ROW = 64
PAGE_ROWS, STRIP_ROWS, TILE = 1024, 256, 64


# --- codecs -----------------------------------------------------------------------------------------------------------------------


def packbits(row: bytes) -> bytes:
    """A row as runs of equal bytes (three or more) and literal stretches, of at most 128 each."""
    out, at, n, literal = bytearray(), 0, len(row), 0

    def flush(end: int) -> None:
        for i in range(literal, end, 128):
            part = row[i : min(i + 128, end)]
            out.append(len(part) - 1)
            out.extend(part)

    while at < n:
        c, end = row[at], at + 1
        while end < n and row[end] == c and end - at < 128:
            end += 1
        if end - at >= 3:
            flush(at)
            out.append(257 - (end - at))
            out.append(c)
            literal = end
        at = end
    flush(n)
    return bytes(out)


def unpackbits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, highest bit first; the width grows one code early, as the format has it."""
    codes, widths = [256], [(0, 9)]
    table: dict[int, int] = {}
    get, emit, free = table.get, codes.append, 258
    if data:
        it = iter(data)
        w = next(it)
        for c in it:
            v = get(w << 8 | c)
            if v is not None:
                w = v
                continue
            emit(w)
            table[w << 8 | c] = free
            free += 1
            w = c
            if free in (512, 1024, 2048):
                widths.append((len(codes), free.bit_length()))
            elif free == 4095:
                emit(256)
                widths.append((len(codes), 9))
                table.clear()
                free = 258
        emit(w)
        if free in (511, 1023, 2047):
            widths.append((len(codes), (free + 1).bit_length()))
    emit(257)
    starts = [i for i, _ in widths] + [len(codes)]
    size = np.repeat([b for _, b in widths], np.diff(starts))
    shift = size[:, None] - 1 - np.arange(12)
    bits = (np.array(codes)[:, None] >> np.maximum(shift, 0)) & 1
    return np.packbits(bits[shift >= 0].astype(np.uint8)).tobytes()


def unlzw(data: bytes, size: int) -> bytes:
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    table, out, done, bit, width, before = list(first), [], 0, 0, 9, None
    data, end = data + b"\0\0\0", 8 * len(data)
    while bit + width <= end and done < size:
        at = bit >> 3
        code = ((data[at] << 16 | data[at + 1] << 8 | data[at + 2]) >> (24 - width - (bit & 7))) & ((1 << width) - 1)
        bit += width
        if code == 257:
            break
        if code == 256:
            table, width, before = list(first), 9, None
            continue
        if before is None:
            entry = table[code]
        else:
            if code > len(table):
                raise ValueError("an LZW code that is not in the table yet")
            entry = table[code] if code < len(table) else before + before[:1]
            table.append(before + entry[:1])
            if len(table) in (511, 1023, 2047):
                width += 1
        before = entry
        out.append(entry)
        done += len(entry)
    return b"".join(out)


def _encode(block: np.ndarray, compression: int, predictor: int) -> bytes:
    if predictor == 2:
        block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1)
    if compression == PACKBITS:
        return b"".join(packbits(r.tobytes()) for r in block)
    data = block.tobytes()
    return lzw(data) if compression == LZW else zlib.compress(data, 1) if compression == DEFLATE else data


def _decode(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        got = data[:size]
    elif compression == PACKBITS:
        got = unpackbits(data, size)
    elif compression == LZW:
        got = unlzw(data, size)
    elif compression in (DEFLATE, OLD_DEFLATE):
        got = zlib.decompressobj().decompress(data, size)
    else:
        raise ValueError(f"compression {compression}")
    if len(got) < size:
        raise ValueError(f"a strip or tile of {len(got)} bytes instead of {size}")
    return got[:size]


# --- files ------------------------------------------------------------------------------------------------------------------------


class Page(NamedTuple):
    page: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    pixels: bytes  # rows from top to bottom, samples of a pixel together; little-endian


BAD = (ValueError, struct.error, zlib.error, IndexError, MemoryError, OverflowError)


def write(payload: bytes, compression: int = DEFLATE, predictor: int = 2, tiled: bool = False) -> bytes:
    """Payload (a multiple of ROW bytes) as grey pages, ROW samples wide, of at most PAGE_ROWS rows."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, ROW)
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for top in range(0, len(rows), PAGE_ROWS):
        page = rows[top : top + PAGE_ROWS]
        step = TILE if tiled else STRIP_ROWS
        parts = []
        for y in range(0, len(page), step):
            block = page[y : y + step]
            if tiled and len(block) < step:  # tiles are whole
                block = np.concatenate([block, np.zeros((step - len(block), ROW), dtype=np.uint8)])
            parts.append(_encode(block, compression, predictor))
        offsets = []
        for p in parts:
            offsets.append(len(out))
            out += p
        out += b"\0" * (len(out) % 2)
        lists = {}
        for name, values in (("offsets", offsets), ("counts", [len(p) for p in parts])):
            lists[name] = values[0] if len(values) == 1 else len(out)
            if len(values) > 1:
                out += struct.pack(f"<{len(values)}I", *values)
        n = len(parts)
        place, count = (TILE_OFFSETS, TILE_COUNTS) if tiled else (STRIP_OFFSETS, STRIP_COUNTS)
        tags = [(WIDTH, 4, 1, ROW), (LENGTH, 4, 1, len(page)), (BITS, 3, 1, 8), (COMPRESSION, 3, 1, compression), (PHOTOMETRIC, 3, 1, 1), (SAMPLES, 3, 1, 1), (PREDICTOR, 3, 1, predictor), (place, 4, n, lists["offsets"]), (count, 4, n, lists["counts"])]
        tags += [(TILE_WIDTH, 4, 1, ROW), (TILE_LENGTH, 4, 1, TILE)] if tiled else [(ROWS_PER_STRIP, 4, 1, STRIP_ROWS)]
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in sorted(tags))
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


Tags = dict[int, tuple[int, ...]]


def directories(media: bytes) -> tuple[str, list[Tags | str]]:
    """(byte order, the tags of each directory of the chain); where the chain breaks off, the reason comes last."""
    order = {b"II": "<", b"MM": ">"}.get(media[:2])
    if order is None or struct.unpack_from(order + "H", media, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack_from(order + "I", media, 4)
    seen: set[int] = set()
    out: list[Tags | str] = []
    while at and at not in seen:
        seen.add(at)
        try:
            (n,) = struct.unpack_from(order + "H", media, at)
            tags: Tags = {}
            for i in range(n):
                tag, kind, count = struct.unpack_from(order + "HHI", media, at + 2 + 12 * i)
                if kind in _KINDS:
                    code = f"{order}{count}{_KINDS[kind]}"
                    inline = struct.calcsize(code) <= 4
                    tags[tag] = struct.unpack_from(code, media, at + 10 + 12 * i if inline else struct.unpack_from(order + "I", media, at + 10 + 12 * i)[0])
            (at,) = struct.unpack_from(order + "I", media, at + 2 + 12 * n)
        except BAD as e:
            return order, [*out, f"directory {len(out)}: {e}"]
        out.append(tags)
    return order, out


def read(media: bytes) -> Iterator[Page]:
    """The pages of a file, one at a time; raises at the first that can't be decoded."""
    order, found = directories(media)
    for number, tags in enumerate(found):
        if isinstance(tags, str):
            raise ValueError(tags)
        yield page_of(media, tags, order, number)


def _samples(raw: bytes, order: str, bits: int, predictor: int, rows: int, columns: int, samples: int) -> np.ndarray:
    """Decoded bytes as rows x columns x samples, the predictor undone, little-endian."""
    if bits < 8:  # rows begin at whole bytes
        ones = np.unpackbits(np.frombuffer(raw, dtype=np.uint8).reshape(rows, -1), axis=1)[:, : columns * samples * bits]
        return (ones.reshape(rows, columns * samples, bits) @ (1 << np.arange(bits)[::-1])).astype(np.uint8).reshape(rows, columns, samples)
    size = bits // 8
    if predictor == 3:  # bytes of a row by significance, highest first, each less the one `samples` before it
        planes = np.frombuffer(raw, dtype=np.uint8).reshape(rows, size * columns, samples)
        planes = np.cumsum(planes, axis=1, dtype=np.uint8).reshape(rows, size, columns * samples)
        return np.ascontiguousarray(planes[:, ::-1].transpose(0, 2, 1)).view(f"<u{size}").reshape(rows, columns, samples)
    got = np.frombuffer(raw, dtype=f"{order}u{size}").astype(f"<u{size}").reshape(rows, columns, samples)
    return np.cumsum(got, axis=1, dtype=got.dtype) if predictor == 2 else got


def page_of(media: bytes, tags: Tags, order: str, number: int) -> Page:
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, samples, bits = one(WIDTH, 0), one(LENGTH, 0), one(SAMPLES, 1), one(BITS, 1)
    compression, predictor, planar = one(COMPRESSION, NONE), one(PREDICTOR, 1), one(PLANAR, 1)
    if bits not in (1, 2, 4, 8, 16, 32, 64) or any(b != bits for b in tags.get(BITS, ())) or predictor not in ((1,) if bits < 8 else (1, 2) if bits == 8 else (1, 2, 3)) or planar not in (1, 2):
        raise ValueError(f"{bits} bits, predictor {predictor}, planes {planar}")
    own, planes = (1, samples) if planar == 2 else (samples, 1)

    def block(place: int, size: int, rows: int, columns: int) -> np.ndarray:
        raw = _decode(media[place : place + size], compression, rows * (-(-columns * own * bits // 8)))
        return _samples(raw, order, bits, predictor, rows, columns, own)

    tiled = TILE_OFFSETS in tags
    places = list(zip(tags.get(TILE_OFFSETS if tiled else STRIP_OFFSETS, ()), tags.get(TILE_COUNTS if tiled else STRIP_COUNTS, ()), strict=True))
    w, h = (one(TILE_WIDTH, 0), one(TILE_LENGTH, 0)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height) or 1)
    if not (w and h):
        raise ValueError("no size")
    across, down = -(-width // w), -(-height // h)
    if len(places) != across * down * planes:
        raise ValueError(f"{len(places)} of {across * down * planes} strips or tiles")
    page = np.zeros((down * h, across * w, samples), dtype=f"<u{max(1, bits // 8)}")
    for i, (place, size) in enumerate(places):
        plane, k = divmod(i, across * down)
        y, x = k // across * h, k % across * w
        rows = h if tiled else min(h, height - y)
        page[y : y + rows, x : x + w, plane * own : plane * own + own] = block(place, size, rows, w)
    return Page(number, width, height, samples, bits, compression, page[:height, :width].tobytes())


# --- columns ----------------------------------------------------------------------------------------------------------------------

#: How a payload is stored, by its crc32: a third by each codec, in strips and in tiles, with and without predictor.
SCHEMES = ((DEFLATE, 2, False), (LZW, 1, False), (PACKBITS, 1, True), (DEFLATE, 1, True), (LZW, 2, True), (PACKBITS, 2, False))
_PAGES = "doc_id bigint, n_bytes bigint, page int, n_pages int, width int, height int, samples int, bits int, compression int, pixels binary, media_bytes bigint, media_sha256 string, error string"
_PAGE_FIELDS = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("page", pa.int32()), ("n_pages", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.int32()), ("bits", pa.int32()), ("compression", pa.int32()), ("pixels", pa.binary()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("error", pa.string())]
_BATCH_BYTES = 4 << 20


def _batches(rows: Iterator[tuple], fields: list, weight: int) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about _BATCH_BYTES of their column `weight`, so that memory doesn't grow with a partition."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[weight] or b"") + 200
        if size >= _BATCH_BYTES:
            yield _batch(held, fields)
            held, size = [], 0
    if held:
        yield _batch(held, fields)


def _batch(rows: list[tuple], fields: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def payload_of(text: str | None) -> tuple[bytes, int]:
    """A text's bytes, with zeros up to a positive multiple of ROW, and how many they were before."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b"\0" * (-len(data) % ROW or ROW * (not data)), len(data)


def encode(df: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text stored as a TIFF file."""
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for doc_id, t in zip(b.column(0), b.column(1), strict=True):
                payload, n = payload_of(t.as_py())
                yield doc_id.as_py(), n, write(payload, *SCHEMES[zlib.crc32(payload) % len(SCHEMES)])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(lambda it: _batches(rows(it), fields, 2), "doc_id bigint, n_bytes bigint, media binary")


def pages(df: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) in, a row per page out; the pages of a file follow one another, in order."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for doc_id, n, media in zip(*b.columns, strict=True):
                doc_id, n, media = doc_id.as_py(), n.as_py(), media.as_py()
                if media is None:
                    continue
                digest = hashlib.sha256(media).hexdigest()
                try:
                    order, found = directories(media)
                    error = "no pages"
                    if found and isinstance(found[0], str):
                        found, error = [], found[0]
                except BAD as e:
                    found, error = [], str(e) or type(e).__name__
                for number, tags in enumerate(found):
                    try:
                        if isinstance(tags, str):
                            raise ValueError(tags)
                        p = page_of(media, tags, order, number)
                        yield doc_id, n, number, len(found), p.width, p.height, p.samples, p.bits, p.compression, p.pixels, len(media), digest, None
                    except BAD as e:
                        yield doc_id, n, number, len(found), None, None, None, None, None, None, len(media), digest, str(e) or type(e).__name__
                if not found:
                    yield doc_id, n, None, 0, None, None, None, None, None, None, len(media), digest, error

    return df.select("doc_id", "n_bytes", "media").mapInArrow(lambda it: _batches(rows(it), _PAGE_FIELDS, 9), _PAGES)


def feature(pixels: np.ndarray, n_pages: int) -> str:
    """What a thumbnail shows: pages, rows, mean grey, and a bit for each of 8 x 8 areas that is brighter than the mean."""
    rows = pixels.reshape(-1, ROW)
    down = np.add.reduceat(rows.sum(axis=1, dtype=np.int64).reshape(-1, 1), np.unique(np.arange(8) * len(rows) // 8), axis=0)
    areas = np.add.reduceat(rows.reshape(len(rows), 8, 8).sum(axis=2, dtype=np.int64), np.unique(np.arange(8) * len(rows) // 8), axis=0)
    size = np.diff(np.r_[np.unique(np.arange(8) * len(rows) // 8), len(rows)])[:, None] * 8
    total = int(down.sum())
    bits = np.packbits((areas * rows.size > total * size).reshape(-1)).tobytes().hex()
    return f"pages={n_pages};rows={len(rows)};mean={total // rows.size};bright={bits}"


def digests(found: DataFrame) -> DataFrame:
    """Page rows in, a row per file out: the payload read back from its pages, in order, and what follows from it; nulls where a page has an error."""
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_pages", pa.int32())]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held: list[bytes] = []
        for b in batches:
            for doc_id, n, page, n_pages, pixels, media_bytes, media_sha in zip(*(b.column(c).to_pylist() for c in (0, 1, 2, 3, 9, 10, 11)), strict=True):
                if page is None:
                    yield doc_id, n, None, None, None, media_bytes, media_sha, None, 0
                    continue
                if not page:
                    held = []
                held.append(pixels)
                if page + 1 == n_pages and any(x is None for x in held):
                    yield doc_id, n, None, None, None, media_bytes, media_sha, None, n_pages
                    held = []
                elif page + 1 == n_pages:
                    payload = b"".join(held)
                    yield doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), media_bytes, media_sha, feature(np.frombuffer(payload, dtype=np.uint8), n_pages), n_pages
                    held = []

    return found.mapInArrow(lambda it: _batches(rows(it), fields, 7), "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_pages int")
