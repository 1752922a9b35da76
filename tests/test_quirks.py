"""Behaviour that decides parity, and the edge cases of masked statistics."""

import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tessera.operators import pixels as P, stats as S, structure as T

NAN, INF = float("nan"), float("inf")


def px(spark, rows):
    """rows: (band, value, nodata, masked, alpha0)."""
    return spark.createDataFrame(rows, "band int, value double, is_nodata boolean, is_masked boolean, is_alpha0 boolean")


def test_unsigned_types_are_checked_as_signed_only_in_compat_mode(spark):
    df = spark.createDataFrame([(65535.0, "UInt16"), (-1.0, "UInt16"), (4e9, "UInt32"), (-3.4028235e38, "Float32"), (INF, "Float64"), (0.5, "Byte"), (NAN, "Int16"), (NAN, "Float32")], "v double, t string")
    got = [(r.a, r.b) for r in df.select(P.nodata_fits(F.col("v"), F.col("t")).alias("a"), P.nodata_fits(F.col("v"), F.col("t"), compat=True).alias("b")).collect()]
    assert got == [(True, False), (False, True), (True, False), (False, False), (False, False), (False, False), (False, False), (True, True)]


def test_nan_is_nodata_and_infinities_count_nowhere(spark):
    rows = [(1, NAN, False, False, False), (1, INF, False, False, False), (1, 2.0, False, False, False), (1, 4.0, False, True, False), (1, 9.0, True, False, False), (1, 6.0, False, False, True)]
    r = S.band_statistics(px(spark, rows), "band").first()
    assert (r.pixels, r.valid_count, r.nodata_count, r.mask_count, r.alpha_0_count) == (6, 1, 2, 1, 1)
    assert r.minimum == r.maximum == r["median"] == 2.0 and r.valid_percent == pytest.approx(100 / 6, abs=1e-6)


def test_band_without_valid_pixels(spark):
    rows = [(1, 5.0, True, False, False), (2, 7.0, False, False, False)]
    found = {r.band: r for r in S.band_statistics(px(spark, rows), "band").collect()}
    assert found[1].valid_count == 0 and found[1].minimum is None and found[1]["median"] is None
    df = px(spark, rows)
    assert {r.band for r in S.histogram(df, S.histogram_plan(df, "band"), "band").collect()} == {2}


def test_constant_band_has_one_bin(spark):
    df = px(spark, [(1, 1.5, False, False, False)] * 5)
    rows = S.histogram(df, S.histogram_plan(df, "band"), "band").collect()
    assert [(r.bin, r["count"]) for r in rows] == [(0, 5)]
    assert [(r.bin, r["count"]) for r in S.histogram(df, S.pam_plan(df, "band"), "band").collect()] == [(0, 5)]


def test_side_car_bins_follow_the_type(spark):
    bands = [("Byte", [0, 5, 5, 255]), ("UInt16", [3, 10, 10, 90]), ("UInt32", [7, 4e9, 3e9, 12]), ("UInt16", [4, 4]), ("Int16", [-5, 0, 9]), ("Float32", [0.25, 0.5, 8.0]), ("Byte", [9, 9])]
    rows = [(i, float(v), False, False, False) for i, (_, values) in enumerate(bands) for v in values]
    df = px(spark, [*rows, (len(bands), 1.0, True, False, False)])
    names = F.get(F.array(*[F.lit(t) for t, _ in bands]), F.col("band"))
    found = {}
    for r in S.histogram(df, S.pam_plan(df, "band", dtype=names), "band").orderBy("band", "bin").collect():
        found.setdefault(r.band, []).append((r.left, r.right, r["count"]))
    assert set(found) == set(range(len(bands)))  # a band without valid pixels has no bins
    want = [(0, 256, 256), (-0.5, 90.5, 87), (-0.5, 4e9 + 0.5, 256), (-0.5, 4.5, 1), (-5, 9, 256), (0.25, 8, 256), (0, 256, 256)]
    for i, (lo, hi, n) in enumerate(want):
        assert (found[i][0][0], found[i][-1][1], len(found[i])) == (lo, hi, n)
        assert [c for _, _, c in found[i]] == np.histogram(bands[i][1], np.linspace(lo, hi, n + 1))[0].tolist()


def test_values_on_edges_lie_right_and_the_maximum_in_the_last_bin(spark):
    values = [0.0, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 3.25, 4.0]
    df = px(spark, [(1, v, False, False, False) for v in values])
    plan = spark.createDataFrame([(1, 0.0, 4.0, 4)], "band int, lo double, hi double, bins int")
    got = [r["count"] for r in S.histogram(df, plan, "band").orderBy("bin").collect()]
    assert got == np.histogram(values, np.linspace(0, 4, 5))[0].tolist()


def test_mask_skips_bands_without_nodata(spark):
    rows = [(1, 0, True), (1, 1, False), (2, 0, True), (2, 1, True), (3, 0, False), (3, 1, False)]
    df = spark.createDataFrame(rows, "band int, place int, none boolean").withColumn("value", F.lit(0.0))
    assert {r.place: r["mask"] for r in P.nodata_mask(df, F.col("none"), ["place"]).collect()} == {0: 0, 1: 255}
    none = df.withColumn("none", F.lit(False))
    assert {r["mask"] for r in P.nodata_mask(none, F.col("none"), ["place"]).collect()} == {255}


def test_efficiency_is_zero_without_compression_and_may_be_negative(spark):
    rows = [(1, 10, 10, 8, 1, 1, 500), (2, 10, 10, 8, 1, 5, 150), (3, 10, 10, 8, 3, 5, 150), (3, 10, 10, 8, 3, 1, 300)]
    df = spark.createDataFrame(rows, "file_id int, width int, height int, bits int, bands int, compression int, bytecount long").withColumn("ifd", F.lit(0))
    assert {r.file_id: r.efficiency for r in T.compression_efficiency(df, "file_id").collect()} == {1: 0.0, 2: -50.0, 3: 25.0}
    savings = T.ifd_savings(df.where("file_id = 3").withColumn("bytecount", F.lit(0).cast("long"))).first()
    assert savings.savings == 100.0 and savings.ratio is None  # one bits value for all bands, no ratio without bytes


@settings(max_examples=3, deadline=None)
@given(st.lists(st.lists(st.sampled_from([0.1, 0.2, 1.0, -3.5, 7.25, 1e6, -1e-3]), min_size=1, max_size=40), min_size=9, max_size=9))
def test_refined_quantiles_equal_numpy(spark, bands):
    df = px(spark, [(b, v, False, False, False) for b, values in enumerate(bands) for v in values])
    ps = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r.band, r.p): r.quantile for r in S.quantiles_by_refinement(df, ps, "band", bins=4, passes=2).collect()}
    assert len(got) == len(bands) * len(ps)
    for (b, p), q in got.items():
        assert math.isclose(q, float(np.quantile(bands[b], p)), rel_tol=1e-12, abs_tol=1e-12)


def test_rounding_is_half_to_even_on_the_scaled_value(spark):
    values = [0.125, 0.375, 2.5, -2.5, 496.65000000000003, 1.005]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for d in (0, 1, 2):
        assert [r[0] for r in df.select(P.rounded(F.col("v"), d)).collect()] == np.round(values, d).tolist()


def test_pyramid_and_block_order(spark):
    levels = spark.createDataFrame([(1, 0, 100, 100, 8, 900), (1, 1, 50, 120, 20, 950), (1, 2, 25, 25, 10, 100)], "file_id int, level int, width int, height int, ifd_offset long, data_offset long")
    assert {(r.level, r.error) for r in T.pyramid_errors(levels).collect()} == {(0, "data before a smaller level"), (1, "higher than the level before"), (2, "directory before the level before")}
    blocks = spark.createDataFrame([(1, 0, 10), (1, 1, 0), (1, 2, 5), (1, 3, 30)], "file_id int, block int, offset long")
    assert [(r.block, r.before) for r in T.block_order_errors(blocks, ["block"], "file_id").collect()] == [(2, 10)]
