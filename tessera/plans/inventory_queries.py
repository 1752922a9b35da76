"""Queries that show single rows of the inventory, by their numbers, over the small tables; each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import crs as C, markup as M, numbers as N, records as R, text as X
from ..operators import compare, lookup as L, pixels as P, stats as S, structure as T
from ..sources import views as V
from .raster_queries import VALID

QUERIES: dict = {}
c = F.col


def shown(name: str, sql: str):
    """Registers a query under its name with its SQL."""

    def add(query):
        QUERIES[name] = (query, sql)
        return query

    return add


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "customer").withColumn("k", c("c_custkey"))


CUST = "WITH t AS (SELECT *, c_custkey AS k FROM customer)"
IFDS = f"WITH {V.IFDS_SQL}"
PX = f"WITH {V.PIXELS_SQL}"
TP = f"WITH {V.TILE_PIXELS_SQL}"


@shown("f01_valid_pixels", f"{PX} SELECT band, count(*) FILTER ({VALID}) AS valid, count(*) FILTER (NOT {VALID}) AS invalid FROM px GROUP BY band")
def f01(spark, sf_dir):
    v = S.valid(c("value"))
    return V.pixels(spark, sf_dir).groupBy("band").agg(F.count_if(v).alias("valid"), F.count_if(~v).alias("invalid"))


@shown("u03_mask_union", f"{PX} SELECT file_id, count(*) FILTER (is_nodata OR is_masked OR is_alpha0) AS hidden FROM px GROUP BY file_id")
def u03(spark, sf_dir):
    return V.pixels(spark, sf_dir).groupBy("file_id").agg(F.count_if(~S.valid(c("value"))).alias("hidden"))


@shown("f03_byte_data", f"{PX}, v AS (SELECT band, value FROM px WHERE {VALID}) SELECT band, bool_and(value BETWEEN 0 AND 255 AND value % 1 = 0) AS bytes FROM v GROUP BY band")
def f03(spark, sf_dir):
    plan = S.histogram_plan(V.pixels(spark, sf_dir), "band")
    return plan.select("band", ((c("lo") == 0) & (c("hi") == 256) & (c("bins") == 256)).alias("bytes"))


@shown("a08_decimals_by_file", f"{PX}, d AS (SELECT file_id, CASE WHEN value = round_even(value, 0) THEN 0 WHEN abs(value - round_even(value * 10, 0) / 10) < 1e-9 THEN 1 ELSE 2 END AS n FROM px WHERE NOT is_nodata) SELECT file_id, max(n) AS decimals FROM d GROUP BY file_id")
def a08(spark, sf_dir):
    return S.most_decimals(V.pixels(spark, sf_dir), "file_id")


@shown("x01_decimal_places", f"{CUST} SELECT k, CASE WHEN c_acctbal = round_even(c_acctbal, 0) THEN 0 WHEN abs(c_acctbal - round_even(c_acctbal * 10, 0) / 10) < 1e-9 THEN 1 ELSE 2 END AS places FROM t")
def x01(spark, sf_dir):
    return customers(spark, sf_dir).select("k", S.decimal_places(c("c_acctbal")).alias("places"))


@shown("x08_even_edges", "WITH n AS (SELECT n_nationkey AS k, n_nationkey + 1 AS bins FROM nation), e AS (SELECT *, unnest(generate_series(0, bins)) AS i FROM n) SELECT k, CAST(i AS INT) AS i, CASE WHEN i >= bins THEN 10.0::DOUBLE ELSE 2.0::DOUBLE + i * (8.0::DOUBLE / bins) END AS edge FROM e")
def x08(spark, sf_dir):
    n = V.table(spark, sf_dir, "nation").select(c("n_nationkey").alias("k"), (c("n_nationkey") + 1).alias("bins"), F.lit(2.0).alias("lo"), F.lit(10.0).alias("hi"))
    return n.select("*", F.explode(F.sequence(F.lit(0), c("bins").cast("int"))).alias("i")).select("k", "i", S.edge(c("i")).alias("edge"))


@shown("p07_existing_mask", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 > 0 THEN 255 ELSE 0 END AS mask FROM orders")
def p07(spark, sf_dir):
    return V.table(spark, sf_dir, "orders").select(c("o_orderkey").alias("k"), P.plain_mask(c("o_orderkey") % 3).alias("mask"))


@shown("p05_opaque_alpha", "SELECT p_partkey AS k, CASE WHEN p_size * 5 < 230 THEN 0 ELSE 255 END AS alpha FROM part")
def p05(spark, sf_dir):
    return V.table(spark, sf_dir, "part").select(c("p_partkey").alias("k"), P.opaque(c("p_size") * 5).alias("alpha"))


@shown("u04_mask_intersection", f"{TP}, a AS (SELECT tx, row, col, bool_and(value < 0) AS hidden FROM tp GROUP BY ALL) SELECT tx, row, col, CASE WHEN hidden THEN 0 ELSE 255 END AS mask FROM a")
def u04(spark, sf_dir):
    return P.nodata_mask(V.tile_pixels(spark, sf_dir), c("value") < 0, ["tx", "row", "col"])


@shown("p12_ifd_kinds", f"{IFDS} SELECT CASE WHEN ifd % 9 = 0 THEN 'Main' WHEN subfile & 1 <> 0 THEN 'Overview' WHEN subfile & 2 <> 0 THEN 'Page' WHEN subfile & 4 <> 0 THEN 'Mask' ELSE 'Image' END AS kind, count(*) AS n FROM ifds GROUP BY 1")
def p12(spark, sf_dir):
    return V.ifds(spark, sf_dir).groupBy(T.ifd_kind(c("ifd") % 9, c("subfile")).alias("kind")).agg(F.count("*").alias("n"))


@shown("p13_block_sizes", f"{IFDS} SELECT ifd, CASE WHEN tile_w IS NOT NULL THEN tile_w || ' x ' || tile_h ELSE width || ' x ' || greatest(least(coalesce(rows_per_strip, height), height), 1) END AS block FROM ifds")
def p13(spark, sf_dir):
    return V.ifds(spark, sf_dir).select("ifd", T.block_size(c("width"), c("height"), c("tile_w"), c("tile_h"), c("rows_per_strip")).alias("block"))


@shown("p22_tiling_pyramid", """WITH s AS (SELECT c_custkey AS file_id, c_custkey * 37 % 4001 + 1 AS w, c_custkey * 91 % 3001 + 1 AS h FROM customer), n AS (SELECT *, greatest(1, CAST(ceil(log2(greatest(w, h) / 256.0::DOUBLE)) AS INT)) AS levels FROM s), l AS (SELECT *, CAST(unnest(generate_series(0, levels)) AS INT) AS level FROM n)
SELECT file_id, level, CAST(ceil(ceil(w / pow(2, level)) / 256) * ceil(ceil(h / pow(2, level)) / 256) AS BIGINT) AS tiles, 256 * 0.5::DOUBLE * pow(2, level) AS ground FROM l""")
def p22(spark, sf_dir):
    s = customers(spark, sf_dir).select(c("k").alias("file_id"), (c("k") * 37 % 4001 + 1).alias("width"), (c("k") * 91 % 3001 + 1).alias("height"))
    return P.pyramid_rows(s, 256).select("file_id", "level", "tiles", (c("factor") * 128.0).alias("ground"))


@shown("p26_quality_text", "SELECT p_partkey AS k, CASE WHEN p_size % 10 = 0 THEN 'lossless' ELSE '~' || CAST(round_even(100 - p_size % 10, 0) AS BIGINT) END AS quality FROM part")
def p26(spark, sf_dir):
    return V.table(spark, sf_dir, "part").select(c("p_partkey").alias("k"), N.jxl_quality(c("p_size") % 10 / 10).alias("quality"))


@shown("p25_overview_distance", "SELECT p_partkey AS k, CASE WHEN p_size * 2 >= 100 THEN 0.0::DOUBLE ELSE greatest(round_even((100 - p_size * 2) * 10, 0) / 100, 0.01::DOUBLE) END AS distance FROM part")
def p25(spark, sf_dir):
    return V.table(spark, sf_dir, "part").select(c("p_partkey").alias("k"), N.jxl_distance(c("p_size") * 2).alias("distance"))


@shown("p30_name_and_code", f"{CUST} SELECT k, CASE WHEN k % 3 = 0 THEN CASE WHEN k % 2 = 0 THEN 'EPSG:' || (k + 4000) END WHEN k % 2 = 0 THEN c_name || ' (EPSG:' || (k + 4000) || ')' ELSE c_name END AS shown FROM t")
def p30(spark, sf_dir):
    return customers(spark, sf_dir).select("k", X.name_and_code(F.when(c("k") % 3 != 0, c("c_name")), F.when(c("k") % 2 == 0, c("k") + 4000)).alias("shown"))


@shown("p32_extents", f"{CUST}, p AS (SELECT k, unnest([k % 90, NULL, -(k % 40)]) AS x, unnest([1, 2, k % 7]) AS y FROM t) SELECT k, min(coalesce(x, 0))::DOUBLE AS west, min(y)::DOUBLE AS south, max(coalesce(x, 0))::DOUBLE AS east, max(y)::DOUBLE AS north FROM p GROUP BY k")
def p32(spark, sf_dir):
    place = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    points = customers(spark, sf_dir).select("k", F.inline(F.array(place(c("k") % 90, F.lit(1)), place(F.lit(None), F.lit(2)), place(-(c("k") % 40), c("k") % 7))))
    return C.extents(points, "k")


@shown("p33_box_helpers", f"{CUST} SELECT k, (k % 50 + 10) * 2.0::DOUBLE AS width, (k % 30 + 1) * 3.0::DOUBLE AS height, 100 + (k % 50 + 10)::DOUBLE AS center_x FROM t")
def p33(spark, sf_dir):
    box = customers(spark, sf_dir).select("k", *N.native_bbox((100.0, 2.0, 0.0, 50.0, 0.0, -3.0), c("k") % 50 + 10, c("k") % 30 + 1, F.lit(False)))
    return box.select("k", (c("east") - c("west")).alias("width"), (c("north") - c("south")).alias("height"), ((c("east") + c("west")) / 2).alias("center_x"))


@shown("x02_pixel_to_world", f"{CUST} SELECT k, 100 + k * 2.0::DOUBLE + (k % 7) * 0.5::DOUBLE AS x, 50 - k * 0.25::DOUBLE - (k % 7) * 2.0::DOUBLE AS y FROM t")
def x02(spark, sf_dir):
    x, y = N.world((100.0, 2.0, 0.5, 50.0, -0.25, -2.0), c("k"), c("k") % 7)
    return customers(spark, sf_dir).select("k", x.alias("x"), y.alias("y"))


@shown("p34_ranges", f"{PX}, s AS (SELECT file_id, band, CAST(trunc(min(value) FILTER ({VALID})) AS INT) AS lo, CAST(trunc(max(value) FILTER ({VALID})) AS INT) AS hi, count(*) FILTER ({VALID}) AS n FROM px GROUP BY ALL) SELECT file_id, band, CASE WHEN n > 0 THEN lo || ' to ' || hi ELSE 'no valid pixels' END AS range FROM s")
def p34(spark, sf_dir):
    s = S.band_statistics(V.pixels(spark, sf_dir), "file_id", "band")
    return s.select("file_id", "band", R.range_text(c("minimum").cast("int"), c("maximum").cast("int"), c("valid_count")).alias("range"))


@shown("f17_tiled", f"{IFDS} SELECT ifd, coalesce(tile_w IS NOT NULL OR (coalesce(rows_per_strip, height) > 1 AND height > 1 AND coalesce(rows_per_strip, height) >= 1 AND width % 16 = 0), false) AS tiled FROM ifds")
def f17(spark, sf_dir):
    f = V.ifds(spark, sf_dir)
    return f.select("ifd", R.is_tiled(T.block_size(c("width"), c("height"), c("tile_w"), c("tile_h"), c("rows_per_strip"))).alias("tiled"))


@shown("p36_layout_status", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 > 0 THEN 'invalid: ' || (o_orderkey % 5) || ' errors' WHEN o_orderkey % 3 > 0 THEN 'valid with ' || (o_orderkey % 3) || ' warnings' ELSE 'valid' END AS status FROM orders")
def p36(spark, sf_dir):
    return V.table(spark, sf_dir, "orders").select(c("o_orderkey").alias("k"), R.layout_status(c("o_orderkey") % 5, c("o_orderkey") % 3).alias("status"))


@shown("p38_area_or_point", f"{CUST} SELECT k, CASE WHEN k % 4 = 0 THEN 'Area' WHEN k % 3 IN (0, 2) THEN 'Point' ELSE 'Area' END AS pixel_is FROM t")
def p38(spark, sf_dir):
    product = F.get(F.array(*map(F.lit, ("dem", "image", "error"))), (c("k") % 3).cast("int"))
    return customers(spark, sf_dir).select("k", R.area_or_point(F.when(c("k") % 4 == 0, F.lit("Area")), product).alias("pixel_is"))


@shown("p41_target_nodata", f"{CUST} SELECT k, CASE WHEN k % 5 = 0 THEN 1.5::DOUBLE ELSE -9999.0::DOUBLE END AS nodata FROM t")
def p41(spark, sf_dir):
    return customers(spark, sf_dir).select("k", C.target_nodata(F.lit("dem"), F.lit("LZW"), F.lit(-9999.0), F.when(c("k") % 5 == 0, F.lit(1.5))).alias("nodata"))


@shown("p45_compound_crs", """SELECT n_nationkey AS k, 'COMPD_CS["' || n_name || '",PROJCS["a"],VERT_CS["b"]]' AS wkt FROM nation""")
def p45(spark, sf_dir):
    return V.table(spark, sf_dir, "nation").select(c("n_nationkey").alias("k"), M.compound_wkt(c("n_name"), F.lit('PROJCS["a"]'), F.lit('VERT_CS["b"]')).alias("wkt"))


@shown("p46_crs_components", """SELECT n_nationkey AS k, 'PROJCS["' || n_name || '",GEOGCS["g"]]' AS horizontal, 'VERT_CS["h"]' AS vertical FROM nation""")
def p46(spark, sf_dir):
    n = V.table(spark, sf_dir, "nation")
    wkt = M.compound_wkt(F.lit("both"), F.concat(F.lit('PROJCS["'), "n_name", F.lit('",GEOGCS["g"]]')), F.lit('VERT_CS["h"]'))
    return n.select(c("n_nationkey").alias("k"), M.described_wkt(wkt).alias("d")).select("k", "d.horizontal", "d.vertical")


@shown("f06_json_validity", "SELECT event_id, json_valid(CASE WHEN event_id % 3 = 0 THEN props || '}' ELSE props END) AS valid FROM events")
def f06(spark, sf_dir):
    text = F.when(c("event_id") % 3 == 0, F.concat("props", F.lit("}"))).otherwise(c("props"))
    return V.table(spark, sf_dir, "events").select("event_id", M.pretty_json(text).isNotNull().alias("valid"))


@shown("f13_skipped_trials", f"{IFDS} SELECT ifd, CASE WHEN bands = 2 THEN 'no product type' WHEN compression = 7 THEN 'no algorithm' WHEN predictor = 3 AND sample_format <> 3 THEN 'predictor 3 needs floats' END AS skipped FROM ifds")
def f13(spark, sf_dir):
    f = V.ifds(spark, sf_dir)
    return f.select("ifd", compare.skip_reason(F.when(c("compression") != 7, F.lit("LZW")), F.when(c("bands") != 2, F.lit("dem")), c("predictor"), c("sample_format") == 3).alias("skipped"))


@shown("f14_vertical_mismatch", f"{CUST} SELECT k, CASE WHEN k % 4 = 0 THEN false ELSE k % 3 <> 0 END AS differs FROM t")
def f14(spark, sf_dir):
    asked = F.when(c("k") % 4 != 0, F.lit("EGM2008 height"))
    return customers(spark, sf_dir).select("k", R.vertical_differs(asked, F.when(c("k") % 3 == 0, F.lit("egm2008")).otherwise("NAVD88")).alias("differs"))


@shown("f10_rows_with_data", f"{PX}, s AS (SELECT band_name, count(*) FILTER (is_masked) AS mask_count FROM px GROUP BY band_name) SELECT 'mask_count' AS statistic, " + ", ".join(f"max(mask_count) FILTER (band_name = '{n}')::DOUBLE AS {n}" for n, _ in V.BANDS) + " FROM s")
def f10(spark, sf_dir):
    s = S.band_statistics(V.pixels(spark, sf_dir), "band_name").select("band_name", c("mask_count").cast("double").alias("mask_count"), F.lit(0.0).alias("never"))
    return compare.statistics_table(s, [n for n, _ in V.BANDS], ["mask_count", "never"])


@shown("a12_plain_bytes", f"{IFDS} SELECT file_id, sum(width::DOUBLE * height * bits * bands / 8) AS plain FROM ifds GROUP BY file_id")
def a12(spark, sf_dir):
    return V.ifds(spark, sf_dir).groupBy("file_id").agg(F.sum(T.plain_bytes(c("width"), c("height"), c("bits"), c("bands"))).alias("plain"))


@shown("a15_header_size", f'WITH {V.BLOCKS_SQL} SELECT file_id, min("offset") AS header FROM blocks WHERE "offset" > 0 GROUP BY file_id')
def a15(spark, sf_dir):
    return T.first_offsets(V.blocks(spark, sf_dir), "block", "file_id").select("file_id", c("least_offset").alias("header"))


@shown("w02_order_across_bands", """WITH b AS (SELECT l_suppkey AS file_id, l_orderkey AS block, l_linenumber AS band, CAST(floor(l_extendedprice) AS BIGINT) AS "offset" FROM lineitem), s AS (SELECT *, lag("offset") OVER (PARTITION BY file_id ORDER BY block, band, "offset") AS before FROM b WHERE "offset" > 0) SELECT file_id, count(*) AS errors FROM s WHERE "offset" < before GROUP BY file_id""")
def w02(spark, sf_dir):
    b = V.table(spark, sf_dir, "lineitem").select(c("l_suppkey").alias("file_id"), c("l_orderkey").alias("block"), c("l_linenumber").alias("band"), F.floor("l_extendedprice").alias("offset"), F.floor("l_extendedprice").alias("tie"))
    return T.block_order_errors(b, ["block", "band", "tie"], "file_id").groupBy("file_id").agg(F.count("*").alias("errors"))


@shown("w07_first_of_duplicates", "SELECT c_nationkey AS key, min(c_custkey) AS first FROM customer GROUP BY 1")
def w07(spark, sf_dir):
    t = V.table(spark, sf_dir, "customer").select(c("c_nationkey").alias("key"), c("c_custkey").alias("first"))
    return L.first_of_each(t, "key", "first")


@shown("w08_saved_against_baseline", "WITH t AS (SELECT o_custkey AS file_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS trial, CAST(floor(o_totalprice) AS BIGINT) AS size FROM orders) SELECT file_id, trial, round((1 - size::DOUBLE / first_value(size) OVER (PARTITION BY file_id ORDER BY trial)) * 100, 4) AS saved FROM t")
def w08(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    t = V.table(spark, sf_dir, "orders").select(c("o_custkey").alias("file_id"), n.alias("trial"), F.floor("o_totalprice").alias("size"), F.lit(1.0).alias("seconds"))
    return compare.trial_ratios(t).select("file_id", "trial", "saved")


@shown("o02_header_order", f"{CUST} SELECT k, CASE WHEN k % 2 = 0 THEN 'name,' ELSE '' END || 'a,z' || (k % 3) || CASE WHEN k % 5 = 0 THEN ',value' ELSE '' END AS header FROM t")
def o02(spark, sf_dir):
    names = F.concat(F.array(F.concat(F.lit("z"), c("k") % 3)), F.when(c("k") % 5 == 0, F.array(F.lit("value"))).otherwise(F.array().cast("array<string>")), F.array(F.lit("a")), F.when(c("k") % 2 == 0, F.array(F.lit("name"))).otherwise(F.array().cast("array<string>")))
    return customers(spark, sf_dir).select("k", F.concat_ws(",", X.header_order(names)).alias("header"))


@shown("x04_sizes", "SELECT o_orderkey AS k, round(floor(o_totalprice) / 1048576.0::DOUBLE, 6) AS mb FROM orders")
def x04(spark, sf_dir):
    return V.table(spark, sf_dir, "orders").select(c("o_orderkey").alias("k"), F.round(N.megabytes(F.floor("o_totalprice")), 6).alias("mb"))


@shown("x05_speed", "SELECT p_partkey AS k, CASE WHEN p_size % 4 > 0 THEN p_retailprice / (p_size % 4) ELSE 0.0::DOUBLE END AS speed FROM part")
def x05(spark, sf_dir):
    return V.table(spark, sf_dir, "part").select(c("p_partkey").alias("k"), N.speed(c("p_retailprice"), c("p_size") % 4).alias("speed"))


@shown("x06_flag_names", "SELECT o_orderkey AS k, " + "concat_ws(', ', " + ", ".join(f"CASE WHEN o_orderkey & {b} <> 0 THEN '{n}' END" for b, n in L.SUBFILE_BITS.items()) + ") AS flags FROM orders")
def x06(spark, sf_dir):
    return V.table(spark, sf_dir, "orders").select(c("o_orderkey").alias("k"), L.flags(c("o_orderkey"), L.SUBFILE_BITS).alias("flags"))


@shown("x10_outline", "SELECT n_nationkey AS k, array_to_string([n_nationkey, n_nationkey, n_regionkey, n_regionkey], ',') AS outline FROM nation")
def x10(spark, sf_dir):
    return V.table(spark, sf_dir, "nation").select(c("n_nationkey").alias("k"), F.concat_ws(",", N.outline(F.array("n_nationkey", "n_regionkey")).cast("array<string>")).alias("outline"))


@shown("x11_durations", "WITH s AS (SELECT o_orderkey AS k, CAST(floor(o_totalprice / 10) AS BIGINT) AS n FROM orders) SELECT k, CASE WHEN n < 60 THEN n || 's' WHEN n < 3600 THEN (n // 60) || 'm ' || (n % 60) || 's' ELSE (n // 3600) || 'h ' || (n % 3600 // 60) || 'm ' || (n % 60) || 's' END AS shown FROM s")
def x11(spark, sf_dir):
    return V.table(spark, sf_dir, "orders").select(c("o_orderkey").alias("k"), N.duration(c("o_totalprice") / 10).alias("shown"))


@shown("x20_grouped_numbers", f"{CUST} SELECT k, format('{{:,}}', k * 98765) AS shown FROM t")
def x20(spark, sf_dir):
    return customers(spark, sf_dir).select("k", X.grouped(c("k") * 98765).alias("shown"))


@shown("x24_looks_like_xml", f"{CUST} SELECT k, k % 2 = 0 AS is_xml FROM t")
def x24(spark, sf_dir):
    return customers(spark, sf_dir).select("k", X.looks_like_xml(F.concat(F.lit(" <a>"), "c_name", F.when(c("k") % 2 == 0, F.lit("</a> ")).otherwise(F.lit("")))).alias("is_xml"))


@shown("x25_jpeg_tables", "SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN 'Huffman' ELSE 'no tables' END || ' (' || (3 + strlen(s_name)) || ' bytes)' AS tables FROM supplier")
def x25(spark, sf_dir):
    raw = F.concat(F.when(c("s_suppkey") % 2 == 0, F.lit(b"\xff\xc4.")).otherwise(F.lit(b"...")), c("s_name").cast("binary"))
    return V.table(spark, sf_dir, "supplier").select(c("s_suppkey").alias("k"), R.jpeg_tables(raw).alias("tables"))


@shown("x28_renamed_systems", f"{CUST} SELECT k, 'GCS_' || k || '_new' AS name FROM t")
def x28(spark, sf_dir):
    return customers(spark, sf_dir).select("k", X.replaced(F.concat(F.lit("gcs_"), "k", F.lit("_OLD")), [("^gcs_", "GCS_"), ("_old$", "_new")]).alias("name"))


@shown("x30_slugs", "SELECT p_partkey AS k, regexp_replace(regexp_replace(regexp_replace(lower('- ' || p_name || ' (x)'), '\\s+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def x30(spark, sf_dir):
    return V.table(spark, sf_dir, "part").select(c("p_partkey").alias("k"), X.slug(F.concat(F.lit("- "), "p_name", F.lit(" (x)"))).alias("slug"))


@shown("x31_html_escape", f"{CUST} SELECT k, '&lt;' || c_name || ' &amp; &quot;' || k || '&quot;&gt;' AS html FROM t")
def x31(spark, sf_dir):
    return customers(spark, sf_dir).select("k", X.html_escaped(F.concat(F.lit("<"), "c_name", F.lit(' & "'), "k", F.lit('">'))).alias("html"))


@shown("x36_booleans", "SELECT p_partkey AS k, CASE p_size % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS flag FROM part")
def x36(spark, sf_dir):
    word = F.get(F.array(*map(F.lit, (" Yes", "OFF", "1", "perhaps"))), c("p_size") % 4)
    return V.table(spark, sf_dir, "part").select(c("p_partkey").alias("k"), X.as_boolean(word).alias("flag"))


@shown("x55_local_names", "SELECT n_nationkey AS k, n_name AS name FROM nation")
def x55(spark, sf_dir):
    return V.table(spark, sf_dir, "nation").select(c("n_nationkey").alias("k"), X.local_name(F.concat(F.lit("{urn:"), "n_nationkey", F.lit("}"), "n_name")).alias("name"))


@shown("x57_pretty_json", """SELECT n_nationkey AS k, '{' || chr(10) || '  "a": ' || n_nationkey || chr(10) || '}' AS json FROM nation""")
def x57(spark, sf_dir):
    return V.table(spark, sf_dir, "nation").select(c("n_nationkey").alias("k"), M.pretty_json(F.concat(F.lit('{"a":'), "n_nationkey", F.lit("}"))).alias("json"))


@shown("s16_decoded_bytes", "SELECT n_nationkey AS k, n_name || CASE WHEN n_nationkey % 2 = 0 THEN chr(233) ELSE chr(252) END AS text FROM nation")
def s16(spark, sf_dir):
    n = V.table(spark, sf_dir, "nation")
    raw = F.concat(c("n_name").cast("binary"), F.when(c("n_nationkey") % 2 == 0, F.lit(b"\xc3\xa9")).otherwise(F.lit(b"\xfc")))
    return n.select(c("n_nationkey").alias("k"), M.decoded(raw).alias("text"))


@shown("j10_named_or_default", "SELECT s_suppkey AS k, coalesce(n_name, '(missing)') AS name FROM supplier LEFT JOIN nation ON s_suppkey % 40 = n_nationkey")
def j10(spark, sf_dir):
    s = V.table(spark, sf_dir, "supplier").select(c("s_suppkey").alias("k"), (c("s_suppkey") % 40).alias("code"))
    names = V.table(spark, sf_dir, "nation").select(c("n_nationkey").alias("code"), c("n_name").alias("name"))
    return L.named(s, names, "code", "name", "(missing)").select("k", "name")


@shown("m09_report_validity", "SELECT o_custkey AS file_id, count(*) AS n_errors FROM orders GROUP BY 1")
def m09(spark, sf_dir):
    e = V.table(spark, sf_dir, "orders").select(c("o_custkey").alias("file_id"), F.concat(F.lit("error "), c("o_orderkey") % 4).alias("error"))
    return T.layout_report(e).select("file_id", "n_errors")
