"""Queries over the raster views: statistics, pixels, structure; each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import pixels as P, stats as S, structure as T
from ..sources import views as V

VALID = "(NOT (is_nodata OR is_masked OR is_alpha0) AND NOT isnan(value) AND isfinite(value))"

STATS_SQL = f"""count(*) AS pixels, count(*) FILTER ({VALID}) AS valid_count, count(*) FILTER (is_nodata OR isnan(value)) AS nodata_count,
count(*) FILTER (is_masked) AS mask_count, count(*) FILTER (is_alpha0) AS alpha_0_count,
round(count(*) FILTER ({VALID}) * 100.0::DOUBLE / count(*), 6) AS valid_percent, min(value) FILTER ({VALID}) AS minimum, max(value) FILTER ({VALID}) AS maximum,
round(avg(value) FILTER ({VALID}), 6) AS mean, round(stddev_pop(value) FILTER ({VALID}), 6) AS std_dev, round(median(value) FILTER ({VALID}), 6) AS median"""


def a01_band_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.band_statistics(V.pixels(spark, sf_dir), "band", "band_name")


def a01_band_statistics_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.band_statistics(V.pixels(spark, sf_dir), "file_id", "band")


def refined_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = S.quantiles_by_refinement(V.pixels(spark, sf_dir), [0.25, 0.5, 0.75, 0.999], "band")
    return q.select("band", "p", F.round("quantile", 6).alias("quantile"))


def _fd(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = V.pixels(spark, sf_dir)
    return S.histogram(px, S.histogram_plan(px, "band"), "band")


def hist_fd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fd(spark, sf_dir).select("band", "bin", F.round("left", 6).alias("left"), F.round("right", 6).alias("right"), "count")


def _bins_sql(plan: str, source: str) -> str:
    return f"""{plan},
guess AS (SELECT s.band, s.value, p.lo, p.hi, p.bins, CAST(greatest(0, least(p.bins - 1, floor((s.value - p.lo) / ((p.hi - p.lo) / p.bins)))) AS INT) AS g FROM {source} s JOIN plan p USING (band) WHERE s.value BETWEEN p.lo AND p.hi),
fixed AS (SELECT band, CASE WHEN value < (CASE WHEN g >= bins THEN hi ELSE lo + g * ((hi - lo) / bins) END) THEN g - 1
  WHEN value >= (CASE WHEN g + 1 >= bins THEN hi ELSE lo + (g + 1) * ((hi - lo) / bins) END) AND g < bins - 1 THEN g + 1 ELSE g END AS bin FROM guess),
counts AS (SELECT band, bin, count(*) AS n FROM fixed GROUP BY ALL),
every AS (SELECT band, lo, hi, bins, CAST(unnest(generate_series(0, bins - 1)) AS INT) AS bin FROM plan),
hist AS (SELECT e.band, e.bin, CASE WHEN e.bin >= bins THEN hi ELSE lo + e.bin * ((hi - lo) / bins) END AS "left",
  CASE WHEN e.bin + 1 >= bins THEN hi ELSE lo + (e.bin + 1) * ((hi - lo) / bins) END AS "right", coalesce(n, 0) AS count FROM every e LEFT JOIN counts c ON e.band = c.band AND e.bin = c.bin)"""


_FD_PLAN = f"""WITH {V.PIXELS_SQL}, v AS (SELECT band, value FROM px WHERE {VALID}),
sums AS (SELECT band, count(*) AS n, min(value) AS lo, max(value) AS hi, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, bool_and(value BETWEEN 0 AND 255 AND value % 1 = 0) AS bytes FROM v GROUP BY band),
plan AS (SELECT band, CASE WHEN bytes THEN 0.0::DOUBLE ELSE lo END AS lo, CASE WHEN bytes THEN 256.0::DOUBLE WHEN hi - lo <= 0 THEN hi + 1 ELSE hi END AS hi,
  CAST(CASE WHEN bytes THEN 256 WHEN hi - lo <= 0 THEN 1 WHEN 2 * (q3 - q1) * pow(n::DOUBLE, -1.0::DOUBLE / 3) <= 0 THEN 100 ELSE least(100, ceil((hi - lo) / (2 * (q3 - q1) * pow(n::DOUBLE, -1.0::DOUBLE / 3)))) END AS INT) AS bins FROM sums)"""
_HIST_FD = _bins_sql(_FD_PLAN, "v")


def hist_byte(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = V.pixels(spark, sf_dir).withColumn("value", (F.floor(F.col("value") * 5) % 256).cast("double"))
    return S.histogram(px, S.histogram_plan(px, "band"), "band").select("band", "bin", "left", "right", "count")


_BYTE_PLAN = f"WITH {V.PIXELS_SQL}, v AS (SELECT band, floor(value * 5) % 256 AS value FROM px WHERE {VALID}), plan AS (SELECT unnest([1, 2, 3, 4]) AS band, 0.0::DOUBLE AS lo, 256.0::DOUBLE AS hi, 256 AS bins)"


def hist_pam(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = V.pixels(spark, sf_dir)
    hist = S.histogram(px, S.pam_plan(px, "band"), "band")
    return hist.groupBy("band").agg(F.concat_ws("|", F.transform(F.array_sort(F.collect_list(F.struct("bin", "count"))), lambda x: x["count"].cast("string"))).alias("counts"))


_PAM_PLAN = f"WITH {V.PIXELS_SQL}, v AS (SELECT band, value FROM px WHERE {VALID}), plan AS (SELECT band, min(value) AS lo, CASE WHEN max(value) > min(value) THEN max(value) ELSE min(value) + 1 END AS hi, CASE WHEN max(value) > min(value) THEN 256 ELSE 1 END AS bins FROM v GROUP BY band)"


#: Sample types of the four bands, in order.
PAM_TYPES = ["Byte", "UInt32", "Float64", "Int16"]


def hist_pam_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A05 by type: quantities as Byte, whole prices as UInt32, discounts as Float64, taxes in hundredths as Int16."""
    whole = F.when(F.col("band") == 2, F.floor("value").cast("double")).when(F.col("band") == 4, F.floor(F.col("value") * 100).cast("double")).otherwise(F.col("value"))
    px = V.pixels(spark, sf_dir).withColumn("value", whole)
    dtype = F.get(F.array(*map(F.lit, PAM_TYPES)), F.col("band") - 1)
    hist = S.histogram(px, S.pam_plan(px, "band", dtype=dtype), "band")
    counts = F.concat_ws("|", F.transform(F.array_sort(F.collect_list(F.struct("bin", "count"))), lambda x: x["count"].cast("string")))
    return hist.groupBy("band").agg(F.count("*").alias("bins"), F.min("left").alias("lo"), F.max("right").alias("hi"), counts.alias("counts"))


_PAM_TYPES_PLAN = f"""WITH {V.PIXELS_SQL}, typed AS (SELECT band, CASE band WHEN 2 THEN floor(value) WHEN 4 THEN floor(value * 100) ELSE value END AS value, {PAM_TYPES}[band] AS dtype FROM px WHERE {VALID}),
plan AS (SELECT band, CASE dtype WHEN 'Byte' THEN 0 WHEN 'UInt32' THEN -0.5 ELSE min(value) END::DOUBLE AS lo,
  CASE WHEN dtype = 'Byte' THEN 256 WHEN dtype = 'UInt32' THEN max(value) + 0.5 WHEN max(value) > min(value) THEN max(value) ELSE min(value) + 1 END::DOUBLE AS hi,
  CAST(CASE WHEN dtype = 'Byte' THEN 256 WHEN dtype = 'UInt32' THEN greatest(1, least(256, max(value) - min(value))) WHEN max(value) > min(value) THEN 256 ELSE 1 END AS INT) AS bins FROM typed GROUP BY band, dtype)"""


def hist_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.density(_fd(spark, sf_dir), "band").select("band", "bin", F.round("density", 9).alias("density"))


def decimal_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.most_decimals(V.pixels(spark, sf_dir), "band", "band_name")


_PLACES_SQL = "CASE " + " ".join(f"WHEN abs(value - round_even(value * 1e{n}::DOUBLE, 0) / 1e{n}::DOUBLE) < 1e-9 THEN {n}" for n in range(7)) + " ELSE 7 END"


def strided_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    tp = V.tile_pixels(spark, sf_dir)
    return tp.where("row % 4 = 0").groupBy("band").agg(F.count("*").alias("n"), F.round(F.min("value"), 5).alias("lo"), F.round(F.max("value"), 5).alias("hi"))


def nodata_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = V.pixels(spark, sf_dir)
    return px.select("band", P.remapped(F.col("value"), 1.0, -9999.0).alias("value")).groupBy("band").agg(F.count_if(F.col("value") == -9999).alias("remapped"), F.round(F.sum(F.col("value").cast("decimal(20,4)")).cast("double"), 2).alias("total"))


def round_half_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = V.pixels(spark, sf_dir)
    return px.select("band", P.rounded(F.col("value") / 7, 2).alias("value")).groupBy("band", "value").agg(F.count("*").alias("n"))


def alpha_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    alpha = (F.col("l_quantity") * 5).cast("int")
    return V.table(spark, sf_dir, "lineitem").select(alpha.alias("alpha"), P.opaque(alpha).alias("opaque"), P.plain_mask(alpha - 100).alias("mask")).groupBy("alpha", "opaque", "mask").agg(F.count("*").alias("n"))


def nodata_to_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    tp = V.tile_pixels(spark, sf_dir)
    return P.nodata_mask(tp, (F.col("value") < 0) & (F.col("band") < 4), ["tx", "row", "col"])


def nodata_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.explode(F.array(*[F.lit(n) for n in [*P.INTEGER_LIMITS, *P.FLOAT_LIMITS]])).alias("dtype")
    values = V.table(spark, sf_dir, "customer").select(F.col("c_custkey"), (F.floor("c_acctbal") * 7 - 20_000).cast("double").alias("nodata"), names)
    return values.select("c_custkey", "dtype", P.nodata_fits(F.col("nodata"), F.col("dtype")).alias("fits"), P.nodata_fits(F.col("nodata"), F.col("dtype"), compat=True).alias("fits_compat"))


def _fits_sql(compat: bool) -> str:
    limits = dict(P.INTEGER_LIMITS)
    if compat:
        limits |= {"UInt16": limits["Int16"], "UInt32": limits["Int32"]}
    whens = " ".join(f"WHEN dtype = '{k}' THEN nodata BETWEEN {a} AND {b} AND nodata = floor(nodata)" for k, (a, b) in limits.items())
    return f"CASE {whens} WHEN dtype = 'Float32' THEN abs(nodata) < 3.4028234663852886e38 ELSE abs(nodata) < 1.7976931348623157e308 END"


def overview_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.overview_nearest(V.tile_pixels(spark, sf_dir), 2).select("tx", "band", "row", "col", F.round("value", 6).alias("value"))


def overview_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.overview_mean(V.tile_pixels(spark, sf_dir), 2, "tx", "band")


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file_id"), (F.col("c_custkey") * 37 % 9001 + 1).alias("width"), (F.col("c_custkey") * 91 % 7001 + 1).alias("height"))


def overview_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.pyramid_rows(_sizes(spark, sf_dir))


_LEVELS_SQL = """WITH s AS (SELECT c_custkey AS file_id, c_custkey * 37 % 9001 + 1 AS width, c_custkey * 91 % 7001 + 1 AS height FROM customer),
n AS (SELECT *, greatest(1, CAST(ceil(log2(greatest(width, height) / 512.0::DOUBLE)) AS INT)) AS levels FROM s),
l AS (SELECT *, CAST(unnest(generate_series(0, levels)) AS INT) AS level FROM n), f AS (SELECT *, CAST(pow(2, level) AS INT) AS factor FROM l)
SELECT file_id, level, factor, CAST(ceil(width / factor::DOUBLE) AS BIGINT) AS width, CAST(ceil(height / factor::DOUBLE) AS BIGINT) AS height,
CAST(ceil(ceil(width / factor::DOUBLE) / 512) * ceil(ceil(height / factor::DOUBLE) / 512) AS BIGINT) AS tiles FROM f"""


def compression_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.compression_efficiency(V.ifds(spark, sf_dir), "file_id")


def ifd_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.ifd_savings(V.ifds(spark, sf_dir))


def ifd_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return V.ifds(spark, sf_dir).select("file_id", "ifd", T.ifd_kind(c("ifd"), c("subfile")).alias("kind"), T.dtype_name(c("sample_format"), c("bits")).alias("dtype"), T.block_size(c("width"), c("height"), c("tile_w"), c("tile_h"), c("rows_per_strip")).alias("block"), c("tile_w").isNotNull().alias("tiled"))


def block_order_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.block_order_errors(V.blocks(spark, sf_dir), ["block"], "file_id")


def first_block_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.first_offsets(V.blocks(spark, sf_dir), "block", "file_id")


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = V.table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("file_id"), F.col("o_orderkey").alias("level"), (F.col("o_orderkey") * 31 % 977).alias("width"), (F.col("o_orderkey") * 17 % 883).alias("height"), (F.col("o_orderkey") * 100 - F.col("o_orderkey") % 7 * 5000).alias("ifd_offset"), F.floor("o_totalprice").alias("data_offset"))


_ORDERS_SQL = """lv AS (SELECT o_custkey AS file_id, o_orderkey AS level, o_orderkey * 31 % 977 AS width, o_orderkey * 17 % 883 AS height, o_orderkey * 100 - o_orderkey % 7 * 5000 AS ifd_offset, CAST(floor(o_totalprice) AS BIGINT) AS data_offset FROM orders),
seen AS (SELECT *, lag(width) OVER w AS w0, lag(height) OVER w AS h0, lag(ifd_offset) OVER w AS at0, lead(data_offset) OVER w AS next0 FROM lv WINDOW w AS (PARTITION BY file_id ORDER BY level)),
pe AS (SELECT file_id, level, 'wider than the level before' AS error FROM seen WHERE width > w0 UNION ALL SELECT file_id, level, 'higher than the level before' FROM seen WHERE height > h0
UNION ALL SELECT file_id, level, 'directory before the level before' FROM seen WHERE ifd_offset < at0 UNION ALL SELECT file_id, level, 'data before a smaller level' FROM seen WHERE data_offset < next0)"""


def pyramid_order_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.pyramid_errors(_levels(spark, sf_dir))


def mask_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = V.blocks(spark, sf_dir)
    mask = b.select("file_id", "block", (F.col("offset") + F.col("bytecount") + F.when(F.col("block") % 3 == 0, 9).otherwise(8)).alias("offset"))
    return T.mask_adjacency(b, mask)


def cog_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = block_order_errors(spark, sf_dir).select("file_id", F.lit("block out of order").alias("error"))
    return T.layout_report(order, pyramid_order_errors(spark, sf_dir))


_BLOCK_ERRORS = f"""{V.BLOCKS_SQL}, seen_b AS (SELECT file_id, block, "offset", lag("offset") OVER (PARTITION BY file_id ORDER BY block) AS before FROM blocks WHERE "offset" > 0)"""

#: name -> (query, SQL)
QUERIES = {
    "a01_band_statistics": (a01_band_statistics, f"WITH {V.PIXELS_SQL} SELECT band, band_name, {STATS_SQL} FROM px GROUP BY band, band_name"),
    "a01_band_statistics_by_file": (a01_band_statistics_by_file, f"WITH {V.PIXELS_SQL} SELECT file_id, band, {STATS_SQL} FROM px GROUP BY file_id, band"),
    "a03_refined_quantiles": (refined_quantiles, f"WITH {V.PIXELS_SQL}, q AS (SELECT band, unnest([0.25, 0.5, 0.75, 0.999]::DOUBLE[]) AS p, unnest(quantile_cont(value, [0.25, 0.5, 0.75, 0.999])) AS quantile FROM px WHERE {VALID} GROUP BY band) SELECT band, p, round(quantile, 6) AS quantile FROM q"),
    "a04_hist_fd": (hist_fd, _HIST_FD + ' SELECT band, bin, round("left", 6) AS "left", round("right", 6) AS "right", count FROM hist'),
    "a04_hist_byte": (hist_byte, _bins_sql(_BYTE_PLAN, "v") + ' SELECT band, bin, "left", "right", count FROM hist'),
    "a05_hist_pam": (hist_pam, _bins_sql(_PAM_PLAN, "v") + " SELECT band, string_agg(CAST(count AS VARCHAR), '|' ORDER BY bin) AS counts FROM hist GROUP BY band"),
    "a05_hist_pam_types": (hist_pam_types, _bins_sql(_PAM_TYPES_PLAN, "typed") + """ SELECT band, count(*) AS bins, min("left") AS lo, max("right") AS hi, string_agg(CAST(count AS VARCHAR), '|' ORDER BY bin) AS counts FROM hist GROUP BY band"""),
    "a06_hist_density": (hist_density, _HIST_FD + ' SELECT band, bin, round(count::DOUBLE / sum(count * ("right" - "left")) OVER (PARTITION BY band), 9) AS density FROM hist'),
    "a07_decimal_places": (decimal_places, f"WITH {V.PIXELS_SQL} SELECT band, band_name, max({_PLACES_SQL}) AS decimals FROM px WHERE NOT is_nodata AND isfinite(value) GROUP BY band, band_name"),
    "s10_strided_sample": (strided_sample, f"WITH {V.TILE_PIXELS_SQL} SELECT band, count(*) AS n, round(min(value), 5) AS lo, round(max(value), 5) AS hi FROM tp WHERE row % 4 = 0 GROUP BY band"),
    "p01_nodata_remap": (nodata_remap, f"WITH {V.PIXELS_SQL}, m AS (SELECT band, CASE WHEN value = 1 THEN -9999 ELSE value END AS value FROM px) SELECT band, count(*) FILTER (value = -9999) AS remapped, round(CAST(sum(CAST(value AS DECIMAL(20,4))) AS DOUBLE), 2) AS total FROM m GROUP BY band"),
    "p03_round_half_even": (round_half_even, f"WITH {V.PIXELS_SQL} SELECT band, round_even(value / 7 * 100, 0) / 100 AS value, count(*) AS n FROM px GROUP BY ALL"),
    "p04_alpha_threshold": (alpha_threshold, "WITH a AS (SELECT CAST(trunc(l_quantity * 5) AS INT) AS alpha FROM lineitem) SELECT alpha, CASE WHEN alpha < 230 THEN 0 ELSE 255 END AS opaque, CASE WHEN alpha - 100 > 0 THEN 255 ELSE 0 END AS mask, count(*) AS n FROM a GROUP BY ALL"),
    "p08_nodata_to_mask": (nodata_to_mask, f"WITH {V.TILE_PIXELS_SQL}, f AS (SELECT tx, band, row, col, value < 0 AND band < 4 AS none FROM tp), h AS (SELECT band FROM f GROUP BY band HAVING bool_or(none)), a AS (SELECT tx, row, col, bool_and(none) FILTER (band IN (SELECT band FROM h)) AS hidden FROM f GROUP BY ALL) SELECT tx, row, col, CASE WHEN hidden THEN 0 ELSE 255 END AS mask FROM a"),
    "f02_nodata_validity": (nodata_validity, f"WITH n AS (SELECT c_custkey, floor(c_acctbal) * 7 - 20000 AS nodata, unnest({[*P.INTEGER_LIMITS, *P.FLOAT_LIMITS]}) AS dtype FROM customer) SELECT c_custkey, dtype, {_fits_sql(False)} AS fits, {_fits_sql(True)} AS fits_compat FROM n"),
    "a10_overview_nearest": (overview_nearest, f"WITH {V.TILE_PIXELS_SQL} SELECT tx, band, CAST(row // 2 AS INT) AS row, CAST(col // 2 AS INT) AS col, round(value, 6) AS value FROM tp WHERE row % 2 = 0 AND col % 2 = 0"),
    "a10_overview_mean": (overview_mean, f"WITH {V.TILE_PIXELS_SQL} SELECT tx, band, CAST(row // 2 AS INT) AS row, CAST(col // 2 AS INT) AS col, round(CAST(sum(CAST(value AS DECIMAL(28,9))) AS DOUBLE) / count(*), 6) AS value FROM tp GROUP BY tx, band, row // 2, col // 2"),
    "p23_overview_levels": (overview_levels, _LEVELS_SQL),
    "a09_compression_efficiency": (compression_efficiency, f"WITH {V.IFDS_SQL} SELECT file_id, CAST(trunc(sum(width::DOUBLE * height * bits * bands / 8)) AS BIGINT) AS plain_bytes, CAST(sum(bytecount) AS BIGINT) AS stored_bytes, round(CASE WHEN bool_or(compression <> 1) THEN (1 - sum(bytecount)::DOUBLE / sum(width::DOUBLE * height * bits * bands / 8)) * 100 ELSE 0 END, 4) AS efficiency FROM ifds GROUP BY file_id"),
    "a11_ifd_savings": (ifd_savings, f"WITH {V.IFDS_SQL}, p AS (SELECT *, width::DOUBLE * height * bits / 8 AS plain FROM ifds) SELECT file_id, ifd, CAST(plain AS BIGINT) AS plain_bytes, round((1 - bytecount::DOUBLE / plain) * 100, 4) AS savings, round(plain / bytecount::DOUBLE, 4) AS ratio FROM p"),
    "p11_ifd_table": (ifd_table, f"""WITH {V.IFDS_SQL} SELECT file_id, ifd, CASE WHEN ifd = 0 THEN 'Main' WHEN subfile & 1 <> 0 THEN 'Overview' WHEN subfile & 2 <> 0 THEN 'Page' WHEN subfile & 4 <> 0 THEN 'Mask' ELSE 'Image' END AS kind,
CASE sample_format WHEN 1 THEN CASE WHEN bits = 8 THEN 'Byte' ELSE 'UInt' || bits END WHEN 2 THEN 'Int' || bits WHEN 3 THEN 'Float' || bits WHEN 5 THEN 'CInt' || bits WHEN 6 THEN 'CFloat' || bits ELSE 'Undefined' END AS dtype,
CASE WHEN tile_w IS NOT NULL THEN tile_w || ' x ' || tile_h ELSE width || ' x ' || greatest(least(coalesce(rows_per_strip, height), height), 1) END AS block, tile_w IS NOT NULL AS tiled FROM ifds"""),
    "w01_block_order_errors": (block_order_errors, f'WITH {_BLOCK_ERRORS} SELECT file_id, block, "offset", before FROM seen_b WHERE "offset" < before'),
    "w06_first_block_offset": (first_block_offset, f'WITH {V.BLOCKS_SQL} SELECT file_id, arg_min("offset", block) AS first_offset, min("offset") AS least_offset FROM blocks WHERE "offset" > 0 GROUP BY file_id'),
    "w03_pyramid_order_errors": (pyramid_order_errors, f"WITH {_ORDERS_SQL} SELECT file_id, level, error FROM pe"),
    "j12_mask_adjacency": (mask_adjacency, f'WITH {V.BLOCKS_SQL} SELECT file_id, block, "offset", bytecount, "offset" + bytecount + 9 AS mask_offset FROM blocks WHERE block % 3 = 0'),
    "c14_cog_report": (cog_report, f"""WITH {_BLOCK_ERRORS}, {_ORDERS_SQL}, e AS (SELECT file_id, 'block out of order' AS error FROM seen_b WHERE "offset" < before UNION ALL SELECT file_id, error FROM pe),
k AS (SELECT file_id, error, count(*) AS n FROM e GROUP BY ALL) SELECT file_id, CAST(sum(n) AS BIGINT) AS n_errors, string_agg(error || ' (' || n || ')', '; ' ORDER BY error, n) AS errors FROM k GROUP BY file_id"""),
}
