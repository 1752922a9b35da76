import hashlib
import struct
import zlib

import numpy as np
import pytest

from tessera.llm import queries, tiff_pages
from tessera.sources import tiff_format as T

RNG = np.random.default_rng(1)
TEXT = ("the of and to in " * 3000).encode() + b"aaaa" * 500 + bytes(range(256)) * 20


def bytes_of(n):
    return [b"", b"a", b"\0" * n, bytes(RNG.integers(0, 256, n, dtype=np.uint8)), (TEXT * 3)[:n]]


@pytest.mark.parametrize("n", [1, 2, 63, 4096, 200_000])
def test_codecs_round_trip(n):
    for data in bytes_of(n):
        assert T.lzw_decode(T.lzw_encode(data), len(data)) == data
        rows = np.frombuffer(data, np.uint8).reshape(1, -1)
        assert T.packbits_decode(T.packbits_encode(rows), len(data)) == data
        if len(data) % 64 == 0 and data:
            rows = np.frombuffer(data, np.uint8).reshape(-1, 64)
            assert T.packbits_decode(T.packbits_encode(rows), len(data)) == data


def test_known_streams():
    # The examples of the format's description.
    assert T.packbits_decode(bytes.fromhex("FEAA028000 2AFDAA038000 2A22F7AA".replace(" ", "")), 24) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    packed = int("".join(f"{c:09b}" for c in codes).ljust(88, "0"), 2).to_bytes(11, "big")
    assert T.lzw_decode(packed, 100) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("compression", [T.NONE, T.LZW, T.DEFLATE, T.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
def test_pages_round_trip(order, compression, predictor):
    images = [RNG.integers(0, 50, (70, 45, 3)).astype(np.uint8), RNG.integers(0, 9999, (33, 20)).astype(np.uint16), RNG.integers(-5, 5, (1, 1)).astype(np.int32)]
    pages = [(im, T.Layout(compression, predictor, tile, 16, order)) for im, tile in zip(images, [(16, 32), None, None], strict=True)]
    found = list(T.read_pages(T.write_tiff(pages)))
    assert [p.error for p in found] == [None] * 3 and [p.tiled for p in found] == [True, False, False]
    for image, page in zip(images, found, strict=True):
        assert page.pixels == image.astype(image.dtype.newbyteorder("<")).tobytes() and (page.height, page.width) == image.shape[:2]


def test_float_predictor():
    image = RNG.normal(size=(8, 5)).astype("<f4")
    planes = np.ascontiguousarray(image.astype(">f4")).view(np.uint8).reshape(8, 5, 4).transpose(0, 2, 1).reshape(8, 20)
    stored = planes.copy()
    stored[:, 1:] -= planes[:, :-1]
    back = T.undo_predictor(np.frombuffer(stored.tobytes(), "<f4").reshape(8, 5, 1), 3, "<")
    assert np.array_equal(back[:, :, 0], image)


def test_damaged_and_hard_files(spark):
    good = T.write_tiff([(np.zeros((4, 4), np.uint8), T.Layout())])
    loop = bytearray(good)
    at = struct.unpack_from("<I", good, 4)[0]
    entries = struct.unpack_from("<H", good, at)[0]
    struct.pack_into("<I", loop, at + 2 + 12 * entries, at)
    cut = T.write_tiff([(RNG.integers(0, 255, (64, 64)).astype(np.uint8), T.Layout(T.PACKBITS))])
    short = bytearray(cut)
    short[8 : 8 + 65 * 64] = b"\x80" * (65 * 64)  # packets that say nothing
    rows = [(1, good, 0), (2, None, 0), (3, b"", 0), (4, b"hello world", 0), (5, bytes(loop), 0), (6, good[:-20], 0), (1, good, 0), (None, bytes(short), 0)]
    df = spark.createDataFrame(rows, "k int, content binary, pixels int")
    found = tiff_pages.tiff_pages(df).collect()
    assert sorted((str(r.k), r.page.error is None) for r in found) == [("1", True), ("1", True), ("3", False), ("4", False), ("5", True), ("6", False), ("None", False)]
    assert tiff_pages.tiff_pages(df.limit(0)).count() == 0
    clash = tiff_pages.tiff_pages(df.withColumnRenamed("pixels", "Page"))
    assert clash.columns == ["k", "page"] and clash.where("page.error is null").count() == 3
    texts = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "ab" * 9_000_000, "x")], "k int, text string, CONTENT string")
    stored = tiff_pages.stored_pages(texts)
    assert stored.columns == ["k", "text", "content", "page"]
    assert sorted((r.k, len(r.page.pixels)) for r in stored.collect()) == [(1, 64), (2, 64), (3, 18_000_000)]


def test_any_damage_is_an_error_row():
    """Directories with changed bytes, counts of zero and areas without end: pages or error rows, never an exception."""
    rng = np.random.default_rng(7)
    files = [T.write_tiff([(rng.integers(0, 255, (40, 30, s)).astype(d), T.Layout(c, p, tile, 16, o)), (np.zeros((5, 5), np.uint8), T.Layout())]) for s, d, c, p, tile, o in ((1, "u1", T.PACKBITS, 1, None, "<"), (3, "u2", T.LZW, 2, (16, 16), ">"), (2, "f4", T.DEFLATE, 3, None, "<"), (1, "u1", T.ZSTD, 1, (32, 16), "<"))]
    errors = 0
    for n in range(4000):
        data = bytearray(files[n % 4])
        at = struct.unpack_from("<I" if data[:2] == b"II" else ">I", data, 4)[0]
        for _ in range(int(rng.integers(1, 4))):
            where = int(rng.integers(0, 8)) if rng.random() < 0.1 else at + int(rng.integers(0, min(180, len(data) - at)))
            data[where] = int(rng.choice([0, 1, 2, 3, 255, rng.integers(0, 256)]))
        for page in T.read_pages(bytes(data)):
            errors += page.error is not None
            assert (page.pixels is None) == (page.error is not None)
            assert page.pixels is None or len(page.pixels) == page.width * page.height * page.samples * page.bits // 8
    assert errors > 1000


def test_features_by_plain_formulas():
    raw = bytes(range(200)) + b"\5" * 56
    counts = [raw.count(b) for b in set(raw)]
    mean = sum(raw) / 256
    std = (sum((b - mean) ** 2 for b in raw) / 256) ** 0.5
    entropy = -sum(c / 256 * np.log2(c / 256) for c in counts)
    step = sum(abs(a - b) for a, b in zip(raw, raw[1:])) / 255
    assert tiff_pages.page_feature(T.Page(0, pixels=raw)) == f"mean={mean:.4f};std={std:.4f};distinct={len(counts)};entropy={entropy:.4f};step={step:.4f}"
    assert tiff_pages.page_feature(T.Page(0)) is None


def test_query_stores_every_text(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op3_tiff_pages(spark, sf).collect()
    assert len(rows) == len(docs) and len({r.feature for r in rows}) > 100
    for r in rows:
        raw = docs[r.doc_id].encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        media = tiff_pages.payload_page(payload)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert {p.error for p in T.read_pages(tiff_pages.payload_page(b"\0" * 64))} == {None}
