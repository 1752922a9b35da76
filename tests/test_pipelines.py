import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.plans import pipelines as P
from tessera.sources import tiff, tiff_format as T, tiff_format as TF
from tests.test_tiff import folder  # noqa: F401


def test_report(spark, folder):  # noqa: F811
    top = folder[0]
    reports = {r.path.rsplit("/", 1)[1]: r.report for r in P.markdown_reports(spark, top).collect()}
    assert set(reports) == {"dem.tif", "rgb.tiff", "one.tif", "bad.tif"}
    dem = reports["dem.tif"]
    assert dem.index("## Summary") < dem.index("## Tags") < dem.index("## Statistics")
    assert "| 70 x 60 | 1 | Float32 |" in dem and "Overview" in dem and "ProjectedCRSGeoKey | 32610" in dem and "| 4158 | 42 |" in dem
    page = {r.path.rsplit("/", 1)[1]: r.html for r in P.html_reports(spark, top, ["summary", "geokeys"]).collect()}["dem.tif"]
    assert '<a href="#summary">Summary</a> <a href="#geokeys">' in page and "<tr><td>3072</td><td>ProjectedCRSGeoKey</td><td>32610</td></tr>" in page and "<th>Key</th>" in page
    only = {r.section for r in P.read_sections(spark, top, ["tags"]).collect()}
    assert only == {"tags"}
    with pytest.raises(ValueError):
        P.read_sections(spark, top, ["tags", "nonsense"])


def test_optimize_and_compare(spark, folder, tmp_path):  # noqa: F811
    dem = (np.add.outer(np.arange(60), np.arange(70)) * 1.501 + 100).astype(np.float32)
    dem[3:6, 10:20] = -9999
    one = tmp_path / "in"
    one.mkdir()
    (one / "dem.tif").write_bytes(T.write_tiff([(dem, T.Layout(T.NONE, strip_rows=60))]))
    out = f"file://{tmp_path}/out"
    done = P.optimize(spark, str(one), out, "dem", P.Options(tile=32, nodata_from=-9999.0, nodata_to=-32767.0)).collect()
    assert len(done) == 1 and done[0].size > 0
    pages = list(T.read_pages((tmp_path / "out/dem.tif").read_bytes()))
    image = np.frombuffer(pages[0].pixels, "<f4").reshape(60, 70)
    want = np.where(dem == -9999, -32767, np.rint(dem.astype(np.float64) * 100) / 100).astype(np.float32)
    assert np.array_equal(image, want) and [p.width for p in pages] == [70, 35, 18]
    diff = P.compare_files(spark, str(one), f"{tmp_path}/out").collect()
    assert len(diff) == 1 and diff[0].delta < 0 and diff[0].verdict.startswith("smaller by")
    assert P.layout_errors(tiff.files(spark, f"{tmp_path}/out")).where(F.col("error").contains("wider")).count() == 0
    with pytest.raises(ValueError):
        P.optimize(spark, str(one), out, "dem", P.Options(algorithm="JXL"))
    assert P.Options("ZSTD", level=30).problems("dem") == ["ZSTD has no level 30"] and not P.Options("ZSTD", level=22).problems("dem")
    assert P.Options("LZW", level=6).problems("dem") == ["LZW has no level 6"]


def test_trials_and_grid(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, r, [float(r * c % 7) for c in range(32)]) for r in range(32)], "path string, band int, row int, data array<double>")
    got = {r.trial: r for r in P.tested(rows, [P.Options("DEFLATE", 1, tile=32, overviews=False), P.Options("LZW", 1, tile=32, overviews=False)]).collect()}
    assert got[0].saved == 0 and got[1].saved > 50 and got[2].size < got[0].size
    (tmp_path / "grid.csv").write_text("type,algorithm,predictor\ndem,DEFLATE,2\n")
    assert P.read_grid(spark, f"{tmp_path}/grid.csv")[0]["algorithm"] == "DEFLATE"
    (tmp_path / "bad.csv").write_text("type,level\ndem,2\n")
    with pytest.raises(ValueError):
        P.read_grid(spark, f"{tmp_path}/bad.csv")


def test_failures_stay_with_their_file(spark):
    rows = spark.createDataFrame([("good", 1, 0, [1.0, 2.0]), ("bad", 1, 0, [1.0]), ("bad", 1, 1, [1.0, 2.0])], "path string, band int, row int, data array<double>")
    got = {r.path: r.error for r in P.optimized(rows, P.Options(tile=16)).collect()}
    assert got["good"] is None and got["bad"]


def test_long_grid_is_refused(spark, tmp_path):
    for n in (10_000, 10_001):
        (tmp_path / f"{n}.csv").write_text("type,algorithm\n" + "dem,LZW\n" * n)
    assert len(P.read_grid(spark, f"{tmp_path}/10000.csv")) == 10_000
    with pytest.raises(ValueError, match="10000"):
        P.read_grid(spark, f"{tmp_path}/10001.csv")


def test_cog_command(spark, tmp_path):
    """Types, nodata, georeference, remap, rounding and overviews by product; what can't be written has an error."""
    rng = np.random.default_rng(2)
    os.makedirs(tmp_path / "in" / "sub")
    geo = {33550: ("d", (2.0, 2.0, 0.0)), 33922: ("d", (0.0,) * 6), 42113: ("s", b"-9\0")}
    dem = rng.integers(-9, 50, (70, 45)).astype(np.int16)
    real = (rng.random((40, 33)) * 100).astype(np.float32)
    write = lambda name, pages: (tmp_path / "in" / name).write_bytes(TF.write_tiff(pages))
    write("dem.TIF", [(dem, TF.Layout(TF.LZW, strip_rows=7, extra=geo))])
    write("sub/real.tif", [(real, TF.Layout(TF.DEFLATE, 3, (16, 32)))])
    write("rgb.tif", [(np.zeros((8, 8, 3), np.uint8), TF.Layout())])
    write("masked.tif", [(np.zeros((8, 8), np.uint8), TF.Layout()), (np.zeros((8, 8), np.uint8), TF.Layout(extra={254: ("I", (4,))}))])
    (tmp_path / "in" / "cut.tif").write_bytes(TF.write_tiff([(real, TF.Layout())])[:50])
    done = {r.path.rsplit("/", 1)[-1]: r for r in P.optimize_cog(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", "dem", P.Options(tile=16, decimals=1, nodata_from=-9.0, nodata_to=-5.0)).collect()}
    assert len(done) == 5 and {k for k, r in done.items() if r.error} == {"rgb.tif", "masked.tif", "cut.tif"}
    assert sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*") if p.is_file()) == ["dem.TIF", "sub/real.tif"]
    data = (tmp_path / "out" / "dem.TIF").read_bytes()
    pages, dirs = list(TF.read_pages(data)), list(TF.directories(data))
    want = np.where(dem == -9, -5, dem)
    assert np.array_equal(TF.page_image(pages[0])[:, :, 0], want) and b"".join(dirs[0][42113]) == b"-5\0" and dirs[0][33550] == (2.0, 2.0, 0.0)
    for page in pages[1:]:
        want = P.smaller(want[:, :, None], -5.0, "bilinear")[:, :, 0]
        got = TF.page_image(page)[:, :, 0]
        assert got.shape == want.shape and np.abs(got - want).max() <= 1  # levels come from unrounded ones
    assert len(pages) == 4 and max(want.shape) <= 16
    back = TF.page_image(next(TF.read_pages((tmp_path / "out" / "sub" / "real.tif").read_bytes())))[:, :, 0]
    assert np.allclose(back, np.rint(real.astype(float) * 10) / 10, atol=1e-5)


def test_overviews_of_optimize_follow_the_product(spark):
    image = np.arange(64 * 64).reshape(64, 64).astype(np.float32)
    mask = np.where(np.arange(64 * 64).reshape(64, 64) % 3, 255, 0).astype(np.uint8)
    file = TF.write_tiff([(image, TF.Layout(extra={42113: ("s", b"5\0")})), (mask, TF.Layout(extra={254: ("I", (4,))}))])
    for product, level in (("scientific", lambda x: P.smaller(x, 5.0, "bilinear")), ("thematic", lambda x: x[::2, ::2])):
        pages = list(TF.read_pages(P.rewrite(file, P.Options(tile=32).resolved(product))))
        dirs = list(TF.directories(P.rewrite(file, P.Options(tile=32).resolved(product))))
        assert [d.get(254, (0,))[0] for d in dirs] == [0, 4, 1, 5]
        assert np.allclose(TF.page_image(pages[2]), level(image[:, :, None]), atol=1e-3)
        assert np.array_equal(TF.page_image(pages[3])[:, :, 0], mask[::2, ::2])
    rgb = TF.write_tiff([(np.zeros((4, 4, 3), np.uint8), TF.Layout())])
    with pytest.raises(ValueError, match="3 bands"):
        P.rewrite(rgb, P.Options().resolved("dem"))
