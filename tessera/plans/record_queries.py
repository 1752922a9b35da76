"""Queries of record predicates, band arithmetic and positional joins, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import crs as C, exif, numbers as N, records as R
from ..operators import stats as S
from ..sources import views as V


def affine_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    gt = F.array(k.cast("double"), F.lit(3.0), F.when(k % 2 == 0, 0.0).otherwise(4.0), F.lit(0.0), F.when(k % 3 == 0, 0.0).otherwise(4.0), F.lit(-3.0))
    return V.table(spark, sf_dir, "customer").select("c_custkey", R.is_north_up(gt).alias("north_up"), R.resolution(gt)["x"].alias("res_x"), R.resolution(gt)["y"].alias("res_y"))


def ifd_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = V.ifds(spark, sf_dir)
    codec = F.when(F.col("compression") == 5, "LZW").when(F.col("compression") == 8, "Deflate").when(F.col("compression") == 50000, "Zstandard").otherwise("other")
    block = F.concat_ws(" x ", F.coalesce("tile_w", "width"), F.coalesce("tile_h", "rows_per_strip"))
    product = F.get(F.array(*[F.lit(x) for x in ("dem", "image", "error")]), (F.col("ifd") % 3).cast("int"))
    return f.select("ifd", R.predictor_label(F.col("predictor"), codec).alias("predictor"), R.is_tiled(block).alias("tiled"), R.layout_status(F.col("subfile").bitwiseAND(1), F.col("subfile")).alias("status"), R.area_or_point(F.when(F.col("bands") == 1, F.lit("Area")), product).alias("pixel_is"), exif.shown(F.lit(exif.EXPOSURE_TIME), F.array(F.col("width").cast("double")), F.array((F.col("height") * 3).cast("double")), F.lit(None).cast("string")).alias("exposure"), R.vertical_differs(F.when(F.col("bands") > 1, F.lit("EGM2008 height")), F.when(F.col("ifd") % 2 == 0, F.lit("egm2008")).otherwise("NAVD88")).alias("differs"))


_LABELS_SQL = f"""WITH {V.IFDS_SQL}, x AS (SELECT *, CASE WHEN compression IN (5, 8, 50000) THEN true ELSE false END AS uses, coalesce(tile_w, width) AS bw, coalesce(tile_h, rows_per_strip) AS bh FROM ifds)
SELECT ifd, CASE WHEN NOT uses THEN 'n/a' WHEN predictor = 1 THEN 'None' WHEN predictor = 2 THEN 'Horizontal differencing' WHEN predictor = 3 THEN 'Floating point' ELSE 'Unknown (' || predictor || ')' END AS predictor,
coalesce(bh > 1 AND bw % 16 = 0, false) AS tiled, CASE WHEN subfile & 1 > 0 THEN 'invalid: ' || (subfile & 1) || ' errors' WHEN subfile > 0 THEN 'valid with ' || subfile || ' warnings' ELSE 'valid' END AS status,
CASE WHEN bands = 1 THEN 'Area' WHEN ifd % 3 IN (0, 2) THEN 'Point' ELSE 'Area' END AS pixel_is,
width || '/' || (height * 3) AS exposure, bands > 1 AND ifd % 2 <> 0 AS differs FROM x"""


def exif_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as camera tags: a rational or a number each, by the tag that the key chooses."""
    c = F.col
    codes = [exif.EXPOSURE_TIME, exif.F_NUMBER, exif.FOCAL_LENGTH, exif.SHUTTER, 41486, exif.PROGRAM, exif.METERING, exif.FLASH]
    code = F.get(F.array(*map(F.lit, codes)), (c("p_partkey") % 8).cast("int"))
    below = F.when(c("p_partkey") % 8 < 5, F.array(F.floor(c("p_partkey") / 8) % 9).cast("array<double>"))
    number = F.when(c("p_partkey") % 3 == 0, 1).otherwise(c("p_size") % 12)
    return V.table(spark, sf_dir, "part").select("p_partkey", code.alias("code"), exif.shown(code, F.array(number.cast("double")), below, F.lit(None).cast("string")).alias("shown"))


_EXIF_SQL = """WITH t AS (SELECT p_partkey, [33434, 33437, 37386, 37377, 41486, 34850, 37383, 37385][p_partkey % 8 + 1] AS code, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE p_size % 12 END AS n, p_partkey // 8 % 9 AS d FROM part),
v AS (SELECT *, CASE WHEN d <> 0 THEN n / d END AS x FROM t)
SELECT p_partkey, code, CASE code WHEN 33434 THEN n || '/' || d WHEN 33437 THEN 'f/' || printf('%.1f', x) WHEN 37386 THEN printf('%.1f', x) || 'mm' WHEN 37377 THEN printf('%.2f', x) WHEN 41486 THEN printf('%.3f', x)
WHEN 34850 THEN n || ' (' || coalesce(['Not defined', 'Manual', 'Normal program', 'Aperture priority', 'Shutter priority', 'Creative program', 'Action program', 'Portrait mode', 'Landscape mode'][n + 1], 'Unknown') || ')'
WHEN 37383 THEN n || ' (' || coalesce(['Unknown', 'Average', 'Center-weighted average', 'Spot', 'Multi-spot', 'Pattern', 'Partial'][n + 1], 'Unknown') || ')'
ELSE n || CASE WHEN n & 1 = 1 THEN ' (Flash fired)' ELSE ' (Flash did not fire)' END END AS shown FROM v"""


def rgba_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three colour bands with the fourth as their mask: a conditional aggregate by place, no join."""
    tp = V.tile_pixels(spark, sf_dir)
    pick = lambda b: F.max(F.when(F.col("band") == b, F.col("value")))
    cells = tp.groupBy("tx", "row", "col").agg(pick(1).alias("r"), pick(2).alias("g"), pick(3).alias("b"), pick(4).alias("a"))
    return cells.select("tx", "row", "col", F.round("r", 6).alias("r"), F.round("g", 6).alias("g"), F.round("b", 6).alias("b"), F.when(F.col("a") > 0, 255).otherwise(0).alias("mask"))


def band_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics joined to band descriptions by number."""
    s = S.band_statistics(V.pixels(spark, sf_dir), "band")
    names = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(V.BANDS, 1) if n != "tax"], "band int, description string")
    return s.join(names, "band", "left").select("band", F.coalesce("description", F.concat(F.lit("Band "), "band")).alias("description"), R.range_text(F.col("minimum").cast("int"), F.col("maximum").cast("int"), F.col("valid_count")).alias("range"))


def overview_levels_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories joined to overview levels by number less one."""
    o = V.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file_id"), (F.col("o_orderkey") % 6).alias("ifd")).distinct()
    levels = o.where("ifd < 4").select("file_id", F.col("ifd").alias("level"))
    return o.join(levels.withColumn("ifd", F.col("level") + 1), ["file_id", "ifd"])


def carried_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = F.create_map(F.lit("AREA_OR_POINT"), F.lit("Area"), F.lit("OWNER"), F.col("s_name"), F.lit("SOFTWARE"), F.lit("old"))
    m = R.carried(meta, ["AREA_OR_POINT"], {"SOFTWARE": "tessera"})
    wrapped = R.wrap_marks(F.concat(F.lit("a/b/"), "s_name"))
    return V.table(spark, sf_dir, "supplier").select("s_suppkey", F.concat_ws(";", F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))).alias("metadata"), F.length(wrapped).alias("wrapped"), R.without_marks(wrapped).alias("plain"), R.jpeg_tables(F.concat(F.lit(b"\xff\xd8\xff\xdb"), F.col("s_name").cast("binary"))).alias("tables"))


def corners_lonlat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in UTM zones to degrees."""
    k = F.col("c_custkey")
    code = F.when(k % 2 == 0, 32601 + k % 60).otherwise(32701 + k % 60)
    lon, lat = C.utm_to_lonlat(C.utm_zone(code), F.lit(300000.0) + k % 1000 * 400, F.lit(1000000.0) + k % 700 * 10000)
    return V.table(spark, sf_dir, "customer").select("c_custkey", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


def _series(names: tuple[float, ...], term: str) -> str:
    return " + ".join(f"{b!r}::DOUBLE * {term.format(j=2 * j)}" for j, b in enumerate(names, 1))


_LONLAT_SQL = f"""WITH k AS (SELECT c_custkey, c_custkey % 60 + 1 AS zone, c_custkey % 2 <> 0 AS south, 300000.0::DOUBLE + c_custkey % 1000 * 400 AS x, 1000000.0::DOUBLE + c_custkey % 700 * 10000 AS y FROM customer),
a AS (SELECT *, (y - CASE WHEN south THEN {C.SOUTH} ELSE 0 END) / ({C.SCALE}::DOUBLE * {C.RADIUS!r}::DOUBLE) AS xi, (x - 500000) / ({C.SCALE}::DOUBLE * {C.RADIUS!r}::DOUBLE) AS eta FROM k),
b AS (SELECT *, xi - ({_series(C.BETA, "sin({j} * xi) * cosh({j} * eta)")}) AS xi1, eta - ({_series(C.BETA, "cos({j} * xi) * sinh({j} * eta)")}) AS eta1 FROM a), c AS (SELECT *, asin(sin(xi1) / cosh(eta1)) AS chi FROM b)
SELECT c_custkey, round(degrees(atan2(sinh(eta1), cos(xi1))) + zone * 6 - 183, 6) AS lon, round(degrees(chi + {_series(C.DELTA, "sin({j} * chi)")}), 6) AS lat FROM c"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extents of turned images, with heights where they have one band."""
    c = V.table(spark, sf_dir, "customer")
    corners = c.select(F.col("c_custkey").alias("file_id"), F.inline(N.corners((100.0, 2.0, 0.5, 50.0, -0.25, -2.0), F.col("c_custkey") % 91, F.col("c_nationkey"))))
    stats = V.table(spark, sf_dir, "orders").select((F.col("o_orderkey") % (F.col("o_custkey") * 9 + 1)).alias("file_id"), F.col("o_totalprice").alias("minimum"), (F.col("o_totalprice") + 1).alias("maximum"))
    return C.with_heights(C.extents(corners, "file_id"), stats, "file_id")


_BOXES_SQL = """WITH c AS (SELECT c_custkey AS file_id, c_custkey % 91 AS w, c_nationkey AS h FROM customer), p AS (SELECT file_id, w, h, unnest([0, 1, 1, 0, 0.5]::DOUBLE[]) AS a, unnest([0, 0, 1, 1, 0.5]::DOUBLE[]) AS b FROM c),
x AS (SELECT file_id, 100 + a * w * 2 + b * h * 0.5::DOUBLE AS x, 50 + a * w * -0.25::DOUBLE + b * h * -2 AS y FROM p), e AS (SELECT file_id, min(x) AS west, min(y) AS south, max(x) AS east, max(y) AS north FROM x GROUP BY file_id),
s AS (SELECT o_orderkey % (o_custkey * 9 + 1) AS file_id, min(o_totalprice) AS bottom, max(o_totalprice + 1) AS top FROM orders GROUP BY 1 HAVING count(*) = 1) SELECT e.*, bottom, top FROM e LEFT JOIN s USING (file_id)"""


def crs_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P41, P47."""
    k = F.col("c_custkey")
    product = F.get(F.array(*[F.lit(x) for x in ("dem", "image", "error")]), (k % 3).cast("int"))
    nodata = F.when(k % 7 == 0, float("nan")).otherwise(F.lit(-9999.0))
    target = C.target_nodata(product, F.when(k % 2 == 0, "LERC").otherwise("LZW"), nodata, F.when(k % 11 == 0, F.lit(0.0)))
    return V.table(spark, sf_dir, "customer").select("c_custkey", C.chosen_crs(product, F.col("c_name"), F.when(k % 2 == 0, F.lit("EGM96")), F.when(k % 5 == 0, F.lit("EGM2008"))).alias("crs"), F.when(F.isnan(target), None).otherwise(target).alias("nodata"))


QUERIES = {
    "p16_corners_lonlat": (corners_lonlat, _LONLAT_SQL),
    "p20_boxes": (boxes, _BOXES_SQL),
    "p47_crs_choice": (crs_choice, """SELECT c_custkey, CASE WHEN c_custkey % 3 = 1 OR (c_custkey % 5 <> 0 AND c_custkey % 2 <> 0) THEN c_name ELSE c_name || ' + ' || CASE WHEN c_custkey % 5 = 0 THEN 'EGM2008' ELSE 'EGM96' END END AS crs,
CASE WHEN c_custkey % 11 = 0 THEN 0.0::DOUBLE WHEN c_custkey % 7 <> 0 THEN -9999.0::DOUBLE WHEN c_custkey % 2 = 0 THEN -32767.0::DOUBLE END AS nodata FROM customer"""),
    "p31_affine_helpers": (affine_helpers, "SELECT c_custkey, c_custkey % 6 = 0 AS north_up, CASE WHEN c_custkey % 3 = 0 THEN 3.0::DOUBLE ELSE 5 END AS res_x, CASE WHEN c_custkey % 2 = 0 THEN 3.0::DOUBLE ELSE 5 END AS res_y FROM customer"),
    "p14_ifd_labels": (ifd_labels, _LABELS_SQL),
    "x26_exif_values": (exif_values, _EXIF_SQL),
    "p06_rgba_split": (rgba_split, f"WITH {V.TILE_PIXELS_SQL} SELECT tx, row, col, round(max(value) FILTER (band = 1), 6) AS r, round(max(value) FILTER (band = 2), 6) AS g, round(max(value) FILTER (band = 3), 6) AS b, CASE WHEN max(value) FILTER (band = 4) > 0 THEN 255 ELSE 0 END AS mask FROM tp GROUP BY ALL"),
    "j06_band_names": (band_names, f"WITH {V.PIXELS_SQL}, s AS (SELECT band, min(value) AS lo, max(value) AS hi FROM px WHERE NOT (is_nodata OR is_masked OR is_alpha0) GROUP BY band) SELECT band, CASE band WHEN 1 THEN 'quantity' WHEN 2 THEN 'price' WHEN 3 THEN 'discount' ELSE 'Band 4' END AS description, CAST(trunc(lo) AS INT) || ' to ' || CAST(trunc(hi) AS INT) AS range FROM s"),
    "j07_overview_levels": (overview_levels_joined, "WITH o AS (SELECT DISTINCT o_custkey AS file_id, o_orderkey % 6 AS ifd FROM orders) SELECT a.file_id, a.ifd, b.ifd AS level FROM o a JOIN o b ON a.file_id = b.file_id AND a.ifd = b.ifd + 1 WHERE b.ifd < 4"),
    "p39_carried_metadata": (carried_metadata, "SELECT s_suppkey, 'OWNER=' || s_name || ';SOFTWARE=tessera' AS metadata, CAST(length(s_name) + 6 AS INT) AS wrapped, 'a/b/' || s_name AS plain, 'quantisation (' || (4 + strlen(s_name)) || ' bytes)' AS tables FROM supplier"),
}
