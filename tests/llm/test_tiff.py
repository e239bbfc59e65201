import hashlib
import os
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from lumenframe.llm import tiff as T


def test_lzw_gives_the_known_codes():
    x = int.from_bytes(T.lzw(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])), "big")
    assert [(x >> (88 - 9 * (i + 1))) & 511 for i in range(9)] == [256, 7, 258, 8, 8, 258, 6, 6, 257]


@pytest.mark.parametrize("n", [0, 1, 2, 127, 128, 129, 253, 255, 510, 512, 1023, 2049, 5000, 70_000])
def test_codecs_round_trip(n):
    for data in (os.urandom(n), b"a" * n, (b"abc " * n)[:n]):
        assert T.unlzw(T.lzw(data), n) == data and T.unpackbits(T.packbits(data), n) == data


@pytest.mark.parametrize("compression", [T.NONE, T.PACKBITS, T.LZW, T.DEFLATE])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tiled", [False, True])
def test_files_round_trip(compression, predictor, tiled):
    for n in (1, 65, 256, 257, 1024, 2500):
        payload = os.urandom(32 * n) + b"z" * (32 * n)
        pages = list(T.read(T.write(payload, compression, predictor, tiled)))
        assert b"".join(p.pixels for p in pages) == payload and [p.page for p in pages] == list(range(-(-n // T.PAGE_ROWS)))


def test_big_endian_colour_sixteen_bits_with_predictor():
    pixels = np.arange(2 * 3 * 3, dtype=np.uint16).reshape(2, 3, 3) * 4000
    stored = np.concatenate([pixels[:, :1], np.diff(pixels, axis=1)], axis=1).astype(">u2").tobytes()
    tags = [(T.WIDTH, 3, 1, 3 << 16), (T.LENGTH, 3, 1, 2 << 16), (T.BITS, 3, 3, 8), (T.COMPRESSION, 3, 1, 1 << 16), (T.STRIP_OFFSETS, 4, 1, 14), (T.SAMPLES, 3, 1, 3 << 16), (T.STRIP_COUNTS, 4, 1, len(stored)), (T.PREDICTOR, 3, 1, 2 << 16)]
    at = 14 + len(stored)
    media = b"MM\0*" + struct.pack(">I", at) + struct.pack(">3H", 16, 16, 16) + stored + struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHII", *t) for t in tags) + struct.pack(">I", at)
    pages = list(T.read(media))  # the chain points at itself and ends there
    assert len(pages) == 1 and (np.frombuffer(pages[0].pixels, "<u2").reshape(2, 3, 3) == pixels).all()


def media_of(pages, order="<"):
    """A file of pages (tags, blocks): tags {tag: values}, blocks the bytes of its strips."""
    out, link = bytearray((b"II*\0" if order == "<" else b"MM\0*") + b"\0" * 4), 4
    for tags, blocks in pages:
        places = []
        for x in blocks:
            places.append(len(out))
            out += x
        entries = []
        for tag, values in sorted((tags | {T.STRIP_OFFSETS: places, T.STRIP_COUNTS: [len(x) for x in blocks]}).items()):
            data = struct.pack(f"{order}{len(values)}I", *values)
            if len(data) > 4:
                data, at = struct.pack(order + "I", len(out)), out.extend(data)
            entries.append(struct.pack(order + "HHI", tag, 4, len(values)) + data)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0" * 4
    return bytes(out)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("bits", [1, 2, 4])
def test_few_bits_become_bytes(order, bits):
    rng = np.random.default_rng(bits)
    want = rng.integers(0, 1 << bits, (5, 13), dtype=np.uint8)
    ones = ((want[:, :, None] >> np.arange(bits)[::-1]) & 1).reshape(5, -1)
    rows = np.packbits(ones, axis=1)
    media = media_of([({T.WIDTH: [13], T.LENGTH: [5], T.BITS: [bits], T.ROWS_PER_STRIP: [2]}, [rows[i : i + 2].tobytes() for i in (0, 2, 4)])], order)
    (page,) = T.read(media)
    assert (np.frombuffer(page.pixels, np.uint8).reshape(5, 13) == want).all() and page.bits == bits


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("kind", ["f2", "f4", "f8"])
def test_floating_point_predictor(order, kind):
    rng = np.random.default_rng(3)
    want, size = rng.normal(size=(4, 6, 3)).astype("<" + kind), int(kind[1])
    planes = want.reshape(4, 18).view(np.uint8).reshape(4, 18, size)[:, :, ::-1].transpose(0, 2, 1).reshape(4, -1, 3)  # highest byte first
    stored = np.concatenate([planes[:, :1], np.diff(planes, axis=1)], axis=1).tobytes()
    (page,) = T.read(media_of([({T.WIDTH: [6], T.LENGTH: [4], T.BITS: [8 * size] * 3, T.SAMPLES: [3], T.PREDICTOR: [3], T.COMPRESSION: [T.DEFLATE]}, [zlib.compress(stored)])], order))
    assert (np.frombuffer(page.pixels, "<" + kind).reshape(4, 6, 3) == want).all()


def test_planes_are_put_together():
    want = np.random.default_rng(4).integers(0, 256, (5, 7, 3), dtype=np.uint8)
    blocks = [T.packbits(want[y : y + 3, :, k].tobytes()) for k in range(3) for y in (0, 3)]
    (page,) = T.read(media_of([({T.WIDTH: [7], T.LENGTH: [5], T.BITS: [8] * 3, T.SAMPLES: [3], T.PLANAR: [2], T.ROWS_PER_STRIP: [3], T.COMPRESSION: [T.PACKBITS]}, blocks)]))
    assert page.pixels == want.tobytes()


def test_a_bad_page_leaves_the_others(spark):
    one = lambda data, **more: ({T.WIDTH: [4], T.LENGTH: [2], T.BITS: [8]} | {getattr(T, k): [v] for k, v in more.items()}, [data])
    media = media_of([one(b"abcdefgh"), one(b"abc"), one(b"abcdefgh", COMPRESSION=99), one(b"ABCDEFGH")])
    got = T.pages(spark.createDataFrame([(1, 8, media)], "doc_id bigint, n_bytes bigint, media binary")).orderBy("page").collect()
    assert [(r["page"], r["n_pages"], r["pixels"] and bytes(r["pixels"]), bool(r["error"])) for r in got] == [(0, 4, b"abcdefgh", False), (1, 4, None, True), (2, 4, None, True), (3, 4, b"ABCDEFGH", False)]
    assert T.digests(T.pages(spark.createDataFrame([(1, 8, media)], "doc_id bigint, n_bytes bigint, media binary"))).first()["payload_sha256"] is None


def test_query_reads_back_what_was_stored(docs, rows):
    got = T.digests(T.pages(T.encode(docs))).collect()
    want = Counter()
    for i, t, _ in rows:
        data = (t or "").encode()
        payload = data + b"\0" * (-len(data) % 64) or b"\0" * 64
        want[i, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    assert len({(r["media_sha256"], r["feature"]) for r in got if r["doc_id"] in (6, 8)}) == 1 and max(r["n_pages"] for r in got) > 1


def test_pages_and_errors(spark, empty):
    good = T.write(b"q" * 64 * 1500, T.PACKBITS)
    df = spark.createDataFrame([(1, 5, good), (2, 5, good[:90]), (3, 5, b""), (4, 5, None)], "doc_id bigint, n_bytes bigint, media binary")
    got = [(r["doc_id"], r["page"], r["n_pages"], r["height"]) for r in T.pages(df).orderBy("doc_id", "page").collect()]
    assert got == [(1, 0, 2, 1024), (1, 1, 2, 476), (2, None, 0, None), (3, None, 0, None)]
    assert all(r["error"] for r in T.pages(df).where("page is null").collect())
    assert T.digests(T.pages(T.encode(empty))).count() == 0
