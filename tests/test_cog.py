import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import overviews as O
from tessera.sources import cog as C, ranged as R, tiff, tiff_format as T

RNG = np.random.default_rng(11)


def plain_half(image):
    """Bilinear by the definition: each sample of the image weighs by its place in a triangle of four, NaN nothing."""
    h, w = image.shape
    out = np.full((-(-h // 2), -(-w // 2)), np.nan)
    for i in range(out.shape[0]):
        for j in range(out.shape[1]):
            total = weight = 0.0
            for a, wa in enumerate(O.WEIGHTS):
                for b, wb in enumerate(O.WEIGHTS):
                    r, c = 2 * i - 1 + a, 2 * j - 1 + b
                    if 0 <= r < h and 0 <= c < w and not np.isnan(image[r, c]):
                        total, weight = total + wa * wb * image[r, c], weight + wa * wb
            if weight:
                out[i, j] = total / weight
    return out


def table(spark, images):
    rows = [(p, b + 1, r, 0, image[r, :, b].tolist()) for p, image in images.items() for b in range(image.shape[2]) for r in range(len(image))]
    segments = spark.createDataFrame(rows, "path string, band int, row int, col int, data array<double>")
    sizes = spark.createDataFrame([(p, x.shape[1], x.shape[0]) for p, x in images.items()], "path string, width int, height int")
    return segments, sizes


def whole(rows, tile, shape):
    out = np.full((-(-shape[0] // tile) * tile, -(-shape[1] // tile) * tile), np.nan)
    for r in rows:
        out[r.by * tile : (r.by + 1) * tile, r.bx * tile : (r.bx + 1) * tile] = np.frombuffer(r.data).reshape(tile, tile)
    return out[: shape[0], : shape[1]]


@pytest.mark.parametrize("resampling", ["bilinear", "nearest"])
def test_levels_are_those_of_the_whole_image(spark, resampling):
    """Odd sizes, one row or column, missing values: halos make every border as if there were no blocks."""
    images = {"odd": RNG.random((37, 53, 2)), "line": RNG.random((1, 40, 1)), "one": RNG.random((1, 1, 1)), "even": RNG.random((32, 16, 1))}
    images["odd"][RNG.random((37, 53, 2)) < 0.3] = np.nan
    segments, sizes = table(spark, {p: np.where(np.isnan(x), -9, x) for p, x in images.items()})
    blocks = O.blocks_of(segments, sizes, 8, sizes.select("path", F.lit(-9).alias("nodata")))
    rows = O.pyramid(blocks, 8, resampling).collect()
    for path, image in images.items():
        for band in range(image.shape[2]):
            level, want = 0, image[:, :, band]
            while True:
                mine = [r for r in rows if (r.path, r.level, r.band) == (path, level, band + 1)]
                assert {(r.height, r.width) for r in mine} == {want.shape}
                assert np.allclose(whole(mine, 8, want.shape), want, equal_nan=True), (path, level)
                if max(want.shape) <= 8:
                    break
                level, want = level + 1, plain_half(want) if resampling == "bilinear" else want[::2, ::2]
            assert not any(r.path == path and r.level > level for r in rows)


def checks(path):
    """Faults of a cloud-optimised file: order of directories and data, leaders and trailers."""
    data = open(path, "rb").read()
    dirs, faults = list(T.directories(data)), []
    starts = [min(t[T.TILE_OFFSETS]) for t in dirs]
    ends = max(t[-1][0] for t in dirs)
    if ends > min(starts):
        faults.append("data before a directory")
    if starts != sorted(starts, reverse=True) or [t[-1][0] for t in dirs] != sorted(t[-1][0] for t in dirs):
        faults.append("order")
    for t in dirs:
        for at, n in zip(t[T.TILE_OFFSETS], t[T.TILE_COUNTS], strict=True):
            if int.from_bytes(data[at - 4 : at], "little") != n or n >= 4 and data[at + n : at + n + 4] != data[at + n - 4 : at + n]:
                faults.append("leader or trailer")
    return faults


@pytest.mark.parametrize("form", [C.Form("<f4", T.DEFLATE, 3, tile=16), C.Form("<u2", T.ZSTD, 2, tile=32, nodata=7.0, big=True), C.Form("<u1", T.LZW, 1, tile=16)])
def test_files_read_back(spark, tmp_path, form, monkeypatch):
    monkeypatch.setattr(C, "RUN", 3)
    images = {f"x/img{i}.tif": RNG.integers(0, 200, (50 + 13 * i, 41, 2 if i else 1)).astype(float) for i in range(3)}
    segments, sizes = table(spark, images)
    blocks = O.pyramid(O.blocks_of(segments, sizes, form.tile), form.tile)
    done = C.written(blocks, f"file://{tmp_path}/out", form, tags=lambda path: {42113: ("s", b"7\0")}).collect()
    assert {r.error for r in done} == {None} and len(done) == 3 and all(os.path.getsize(r.target) == r.size for r in done)
    assert sorted(os.listdir(tmp_path / "out")) == ["img0.tif", "img1.tif", "img2.tif"]
    for r in done:
        assert checks(r.target) == []
        image = images[r.path]
        data = open(r.target, "rb").read()
        pages = list(T.read_pages(data))
        assert data[2] == (43 if form.big else 42) and data[8 + 8 * bool(form.big) :].startswith(b"GDAL_STRUCTURAL_METADATA_SIZE=000140 bytes\n")
        assert np.array_equal(T.page_image(pages[0]), image.astype(form.dtype))
        small = np.stack([plain_half(image[:, :, b]) for b in range(image.shape[2])], axis=2)
        got = T.page_image(pages[1]).astype(float)
        assert np.allclose(got, small, atol=1e-4 if form.dtype == "<f4" else 0.5 + 1e-9)
    R.register(spark)
    rows = spark.read.format("tiff").option("path", f"file://{tmp_path}/out").option("ifd", 0).load().groupBy("path", "band").agg(F.sum(F.aggregate("data", F.lit(0.0), lambda a, v: a + v)).alias("s")).collect()
    sums = {(os.path.basename(p), b + 1): x[:, :, b].sum() for p, x in images.items() for b in range(x.shape[2])}
    assert {(os.path.basename(r.path), r.band): r.s for r in rows} == pytest.approx(sums)


def test_faults_have_errors_and_leave_no_file(spark, tmp_path):
    images = {"good.tif": np.full((20, 20, 1), 3.0), "bad.tif": np.full((20, 20, 1), 300.0)}
    segments, sizes = table(spark, images)
    blocks = O.blocks_of(segments, sizes, 16)
    done = {r.path: r for r in C.written(blocks, f"file://{tmp_path}/out", C.Form("<u1", tile=16)).collect()}
    assert done["bad.tif"].error and done["bad.tif"].target is None and done["good.tif"].size and os.listdir(tmp_path / "out") == ["good.tif"]
    holed = blocks.where("path = 'good.tif' and not (by = 1 and bx = 1)")
    assert "3 of 4 blocks" in C.written(holed, f"file://{tmp_path}/out2", C.Form("<u1", tile=16)).first().error
    assert C.written(blocks.limit(0), f"file://{tmp_path}/out3", C.Form("<u1", tile=16)).count() == 0


def test_header_of_a_large_file():
    """Places beyond 4 GB: the header turns to 8-byte offsets by itself, and they come back."""
    sizes = np.full(70_000, 100_000, np.int64)
    begins = np.cumsum(sizes) - sizes
    data = C.header([(0, 512 * 70_000, 512, begins, sizes)], 1, C.Form("<u1"), {}, int(sizes.sum()))
    (tags,) = T.directories(data)
    assert data[2] == 43 and tags[T.TILE_OFFSETS][-1] == len(data) + int(begins[-1]) + 4 > 1 << 32
    assert set(tags[T.TILE_COUNTS]) == {99_992}
    small = C.header([(0, 512, 512, begins[:1], sizes[:1])], 1, C.Form("<u1"), {}, 100_000)
    assert small[2] == 42


@pytest.mark.parametrize("vectors", [65, 97])
@pytest.mark.parametrize("name", ["s10_row_stride", "k01_cog_levels"])
def test_mosaic_with_blocks_and_rows_without_values(spark, tmp_path, name, vectors):
    """The last row of embeddings is not full, and not every band reaches it: blocks without samples are written, and rows without samples are none of the result."""
    import duckdb

    from tessera.plans import cog_queries

    rows = [(i, RNG.random(64).astype(np.float32).tolist()) for i in range(vectors)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    query, sql = cog_queries.QUERIES[name]
    got = query(spark, str(tmp_path))
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        want = db.sql(sql)
        places = [got.columns.index(c) for c in want.columns]
        assert sorted(tuple(r[i] for i in places[:-1]) + (round(r[places[-1]], 5),) for r in got.collect()) == sorted((*r[:-1], round(r[-1], 5)) for r in want.fetchall())
