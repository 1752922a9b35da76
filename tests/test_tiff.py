import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import exif
from tessera.operators import lookup, stats
from tessera.sources import tiff, tiff_format as T

RNG = np.random.default_rng(0)


def geo_tags(nodata):
    return {
        33550: ("d", (10.0, 10.0, 0.0)), 33922: ("d", (0.0, 0.0, 0.0, 500000.0, 4600000.0, 0.0)),
        34735: ("H", (1, 1, 0, 3, 1024, 0, 1, 1, 1026, 34737, 5, 0, 3072, 0, 1, 32610)), 34737: ("s", tuple(b"UTM?|\0")),
        42113: ("s", tuple(str(nodata).encode() + b"\0")),
    }


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("rasters")
    dem = RNG.uniform(100, 500, (60, 70)).astype(np.float32)
    dem.ravel()[RNG.choice(dem.size, 42, replace=False)] = -9999
    rgb = RNG.integers(0, 255, (40, 33, 3)).astype(np.uint8)
    (top / "sub").mkdir()
    (top / "sub/dem.tif").write_bytes(T.write_tiff([(dem, T.Layout(T.DEFLATE, 3, (32, 16), extra=geo_tags(-9999))), (dem[::2, ::2], T.Layout(T.LZW, 1, extra={254: ("I", (1,))}))]))
    (top / "rgb.tiff").write_bytes(T.write_tiff([(rgb, T.Layout(T.PACKBITS, 2, None, 7, ">"))]))
    (top / "one.tif").write_bytes(T.write_tiff([(np.array([[7]], np.uint16), T.Layout(T.NONE))]))
    (top / "bad.tif").write_bytes(b"II*\0\x08\0\0\0\xff\xff")
    (top / "note.txt").write_text("no raster")
    return str(top), dem, rgb


def test_tables(spark, folder):
    top, dem, rgb = folder
    content = tiff.files(spark, top)
    assert content.count() == 4
    rows = {(r.path.rsplit("/", 1)[1], r.ifd): r for r in tiff.ifds(content).collect()}
    assert rows["dem.tif", 0].width == 70 and rows["dem.tif", 1].subfile == 1 and rows["rgb.tiff", 0].samples == 3 and rows["bad.tif", 0].error
    geo = tiff.geo(content)
    assert [r.path.rsplit("/", 1)[1] for r in tiff.is_georeferenced(geo).collect()] == ["dem.tif"]
    first = geo.where("ifd = 0 and directory is not null")
    assert first.first().affine == [500000.0, 10.0, 0.0, 4600000.0, 0.0, -10.0] and first.first().nodata == -9999
    keys = first.select(F.inline(lookup.geokeys(F.col("directory"), F.col("doubles"), F.col("ascii")))).collect()
    assert {(k.id, k.value) for k in keys} == {(1024, "1"), (1026, "UTM?"), (3072, "32610")}
    blocks = tiff.blocks(content).where("path like '%dem.tif' and ifd = 0")
    assert blocks.count() == 3 * 4 and blocks.agg(F.sum("bytecount")).first()[0] == rows["dem.tif", 0].bytecount


def test_statistics_against_numpy(spark, folder):
    top, dem, rgb = folder
    found = {(r.file_id.rsplit("/", 1)[1], r.ifd, r.band): r for r in stats.band_statistics(tiff.masked_pixels(spark, top), "file_id", "ifd", "band").collect()}
    good = dem[dem != -9999].astype(np.float64)
    r = found["dem.tif", 0, 1]
    assert (r.nodata_count, r.valid_count, r.pixels) == (42, dem.size - 42, dem.size)
    assert r.minimum == good.min() and r.maximum == good.max()
    assert r["mean"] == pytest.approx(good.mean()) and r.std_dev == pytest.approx(good.std(), abs=1e-5) and r["median"] == pytest.approx(np.median(good), abs=1e-5)
    for b in range(3):
        assert found["rgb.tiff", 0, b + 1]["mean"] == pytest.approx(rgb[:, :, b].mean(), abs=1e-5)
    assert found["one.tif", 0, 1].valid_count == 1


def test_histogram_against_numpy(spark, folder):
    top, dem, _ = folder
    px = tiff.masked_pixels(spark, top).where("file_id like '%dem.tif' and ifd = 0")
    plan = stats.histogram_plan(px, "band")
    rows = stats.histogram(px, plan, "band").orderBy("bin").collect()
    good = dem[dem != -9999].astype(np.float64)
    q1, q3 = np.percentile(good, [25, 75])
    bins = min(100, int(np.ceil((good.max() - good.min()) / (2 * (q3 - q1) * len(good) ** (-1 / 3)))))
    counts, _ = np.histogram(good, np.linspace(good.min(), good.max(), bins + 1))
    assert [r["count"] for r in rows] == counts.tolist()


@pytest.mark.parametrize("codec", [T.NONE, T.LZW, T.DEFLATE, T.PACKBITS, T.ZSTD])
@pytest.mark.parametrize("dtype, predictors", [("u1", (1, 2)), ("i2", (1, 2)), ("f4", (1, 3)), ("f8", (1, 3))])
def test_codecs_round_trip(codec, dtype, predictors):
    image = np.cumsum(RNG.integers(-3, 4, (37, 29, 2)), axis=1).astype(dtype)
    for predictor in predictors:
        for tile in (None, (16, 32)):
            page = next(T.read_pages(T.write_tiff([(image, T.Layout(codec, predictor, tile, 10))])))
            assert page.error is None and page.compression == codec and page.pixels == image.astype(f"<{dtype}").tobytes()


def test_zstandard_levels_and_damage():
    image = np.add.outer(np.arange(256), np.arange(256)).astype(np.int32)
    files = {level: T.write_tiff([(image, T.Layout(T.ZSTD, 2, level=level))]) for level in (None, 1, 9, 19)}
    assert files[None] == files[9] and len(set(map(len, files.values()))) > 1  # levels matter, if not always in their order
    assert {next(T.read_pages(f)).pixels for f in files.values()} == {image.astype("<i4").tobytes()}
    with pytest.raises(ValueError):
        T.decode_segment(b"no frame at all", T.ZSTD, 10)
    with pytest.raises(ValueError):
        T.decode_segment(T.encode_segment(image[:4, :4, None], T.Layout(T.ZSTD)), T.ZSTD, 65)
    assert len(T.decode_segment(T.encode_segment(image[:, :, None], T.Layout(T.ZSTD)), T.ZSTD, 7)) == 7


def with_sub_directory(entries, order="<"):
    """A small file whose tag 34665 points to a directory of entries (code, kind, n, packed)."""
    image = np.zeros((2, 2), np.uint8)
    make = lambda at: T.write_tiff([(image, T.Layout(T.NONE, order=order, extra={34665: ("I", (at,))}))])
    at = len(make(0))
    table, heap = struct.pack(f"{order}H", len(entries)), b""
    end = at + 2 + 12 * len(entries) + 4
    for code, kind, n, packed in entries:
        inline = packed.ljust(4, b"\0") if len(packed) <= 4 else struct.pack(f"{order}I", end + len(heap))
        heap += packed if len(packed) > 4 else b""
        table += struct.pack(f"{order}HHI", code, kind, n) + inline
    return make(at) + table + b"\0\0\0\0" + heap


@pytest.mark.parametrize("order", ["<", ">"])
def test_camera_tags(spark, order):
    pairs = lambda *v: struct.pack(f"{order}{len(v)}I", *v)
    signed = lambda *v: struct.pack(f"{order}{len(v)}i", *v)
    short = lambda v: struct.pack(f"{order}H", v)
    entries = [
        (33434, 5, 1, pairs(1, 125)), (33437, 5, 1, pairs(28, 10)), (34850, 3, 1, short(3)), (36864, 7, 4, b"0230"), (36867, 2, 20, b"2024:05:06 07:08:09\0"),
        (37377, 10, 1, signed(-1, 3)), (37380, 10, 1, signed(1, 0)), (37383, 3, 1, short(9)), (37385, 3, 1, short(17)), (37386, 5, 1, pairs(50, 1)), (37396, 3, 3, struct.pack(f"{order}3H", 5, 6, 7)),
        (41486, 5, 1, pairs(2, 3)), (42034, 5, 4, pairs(24, 1, 70, 1, 28, 10, 0, 0)), (42240, 5, 2, pairs(1, 2, 1, 3)),
    ]
    bad = with_sub_directory(entries, order)[:-200]
    files = spark.createDataFrame([("a", with_sub_directory(entries, order)), ("none", T.write_tiff([(np.zeros((1, 1), np.uint8), T.Layout())])), ("bad", bad)], "path string, content binary")
    rows = tiff.exif(files).select("path", "part", "code", exif.shown(F.col("code"), F.col("numbers"), F.col("denominators"), F.col("text")).alias("shown")).collect()
    assert {r.path for r in rows} <= {"a", "bad"} and {r.part for r in rows} == {34665}
    assert {r.code: r.shown for r in rows if r.path == "a"} == {
        33434: "1/125", 33437: "f/2.8", 34850: "3 (Aperture priority)", 36864: "0230", 36867: "2024:05:06 07:08:09", 37377: "-0.33", 37380: None, 37383: "9 (Unknown)",
        37385: "17 (Flash fired)", 37386: "50.0mm", 37396: "5, 6, 7", 41486: "0.667", 42034: "24.0-70.0mm f/2.8-0.0", 42240: "0.500, 0.333",
    }


def test_tags_of_rationals_bytes_and_xmp(spark):
    extra = {700: ("B", tuple(b"<x:xmpmeta/>"))}
    data = bytearray(T.write_tiff([(np.zeros((1, 1), np.uint8), T.Layout(T.NONE, extra={282: ("d", (1.5,))}))]))
    at = data.index(struct.pack("<HHI", 282, 12, 1))
    data[at : at + 4] = struct.pack("<HH", 282, 5)  # the same eight bytes as a rational
    a, b = struct.unpack("<II", struct.pack("<d", 1.5))
    xmp = bytearray(T.write_tiff([(np.zeros((1, 1), np.uint8), T.Layout(T.NONE, extra={700: ("s", extra[700][1]), 34675: ("s", tuple(b"\0\1\2\3\4\xff"))}))]))
    for code, kind in ((700, 1), (34675, 7)):
        at = xmp.index(struct.pack("<HH", code, 2))
        xmp[at : at + 4] = struct.pack("<HH", code, kind)
    got = {(r.path, r.code): r.value for r in tiff.tags(spark.createDataFrame([("a", bytes(data)), ("b", bytes(xmp))], "path string, content binary")).collect()}
    assert got["a", 282] == f"{a}/{b}" and got["b", 700] == "<x:xmpmeta/>" and got["b", 34675] == "6 bytes"


class _Captured:
    """Stands for a table of files; keeps what would run on its batches."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        self.run = run


@pytest.mark.parametrize("step", ["pixels", "rewritten"])
def test_rows_of_many_small_files_leave_together_and_of_a_large_one_apart(spark, step):
    """A batch for each file made a small file cost as much as a large one; one for all would hold a large file's samples whole."""
    from tessera.plans import pipelines

    small, large = T.write_tiff([(np.arange(64, dtype=np.float32).reshape(8, 8), T.Layout())]), T.write_tiff([(RNG.random((3000, 600)), T.Layout(T.NONE))])
    files = [(str(i), small) for i in range(300)] + [("large", large), ("damaged", large[:40])]
    table = _Captured()
    tiff.pixels(table) if step == "pixels" else pipelines.rewritten(table, pipelines.Options("NONE", 1, overviews=False, tile=16))
    out = list(table.run(iter([pa.RecordBatch.from_arrays([pa.array([f[0] for f in files]), pa.array([f[1] for f in files], pa.binary())], names=["path", "content"])])))
    assert sum(b.num_rows for b in out) == (300 * 8 + 3000 + 1 if step == "pixels" else 302)
    assert len(out) < 10
    assert step != "pixels" or max(b.nbytes for b in out) < 2 * tiff.BATCH_BYTES
    assert [e for b in out for e in b["error"].to_pylist() if e] != []
