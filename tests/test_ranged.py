import os
import struct

import numpy as np
import pytest

from tessera.sources import ranged as R, tiff_format as T

RNG = np.random.default_rng(3)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("ranged")
    os.makedirs(at / "sub")
    image = RNG.integers(0, 60_000, (150, 90, 2)).astype(np.uint16)
    small = RNG.random((7, 5)).astype(np.float32)
    (at / "a.Tif").write_bytes(T.write_tiff([(image, T.Layout(T.DEFLATE, 2, (32, 16))), (small, T.Layout(T.LZW, 3, strip_rows=2, order="<", extra={254: ("I", (1,))}))]))
    (at / "sub" / "b.tiff").write_bytes(T.write_tiff([(small, T.Layout(T.ZSTD))])[:60])
    (at / "notes.txt").write_text("no raster")
    return at, image, small


def read(spark, at, **options):
    R.register(spark)
    reader = spark.read.format("tiff").option("path", f"file://{at}")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def assembled(rows, shape):
    out = np.full(shape, np.nan)
    for r in rows:
        out[r.row, r.col : r.col + len(r.data), r.band - 1] = r.data
    return out


@pytest.mark.parametrize("partition_bytes", [1 << 25, 4000])
def test_pixels_are_the_file(spark, folder, partition_bytes):
    at, image, small = folder
    df = read(spark, at, partition_bytes=partition_bytes)
    rows = [r for r in df.collect() if r.error is None]
    big = [r for r in rows if r.path.endswith("a.Tif")]
    assert np.array_equal(assembled([r for r in big if r.ifd == 0], image.shape), image.astype(float))
    assert np.array_equal(assembled([r for r in big if r.ifd == 1], (*small.shape, 1))[:, :, 0], small.astype(float))
    assert len([r for r in df.collect() if r.error]) == 1 and (df.rdd.getNumPartitions() > 10) == (partition_bytes == 4000)


def test_filters_reach_the_blocks(spark, folder):
    at, image, _ = folder
    df = read(spark, at)
    few = df.where("ifd = 0 and band = 2")
    assert "Filter" not in few._jdf.queryExecution().optimizedPlan().toString().replace("PushedFilters", "") or few.count()
    assert np.array_equal(assembled([r for r in few.collect() if r.error is None], image.shape)[:, :, 1], image[:, :, 1].astype(float))
    stepped = read(spark, at, ifd=0, row_step=50, rows="0:149").collect()
    good = [r for r in stepped if r.error is None]
    assert {r.row for r in good} == {0, 50, 100} and len({r.block for r in good}) == 3 * 3  # 3 of 10 rows of tiles
    assert all(np.array_equal(r.data, image[r.row, r.col : r.col + 32, r.band - 1]) for r in good)


def sparse_file(path, size):
    """A classic file of three pages with its directories far apart, mostly a hole."""
    head = struct.pack("<2sHI", b"II", 42, 8)
    with open(path, "wb") as f:
        at = 8
        f.write(head)
        for i, place in enumerate((8, size // 2, size - 4096)):
            entries = [(256, 4, 1, 1024), (257, 4, 1, 1024), (258, 3, 1, 8), (259, 3, 1, 1), (277, 3, 1, 1), (278, 4, 1, 1024), (273, 4, 1, 4096), (279, 4, 1, 1 << 20)]
            f.seek(place)
            following = (size // 2, size - 4096, 0)[i]
            f.write(struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in sorted(entries)) + struct.pack("<I", following))
        f.truncate(size)
    return at


def test_headers_of_a_3_gb_file_take_little(spark, tmp_path):
    sparse_file(tmp_path / "large.tif", 3 << 30)
    rows = read(spark, tmp_path, table="directories").orderBy("ifd").collect()
    assert [(r.ifd, r.width, r.height, r.bytecount) for r in rows] == [(i, 1024, 1024, 1 << 20) for i in range(3)]
    assert max(r.fetched for r in rows) < 1 << 20
    last = read(spark, tmp_path, ifd=2, rows="5:5").collect()
    assert [len(r.data) for r in last] == [1024] and last[0].row == 5


def test_slices_are_those_of_bytes(tmp_path):
    raw = RNG.integers(0, 256, 200_000).astype(np.uint8).tobytes()
    (tmp_path / "x").write_bytes(raw)
    data = R.Ranged(f"file://{tmp_path}/x")
    for a, b in ((0, 2), (5, 5), (16_380, 16_400), (0, 200_000), (199_990, 300_000), (300_000, 300_005), (20_000, 120_000)):
        assert data[a:b] == raw[a:b]
    assert len(data) == len(raw)
