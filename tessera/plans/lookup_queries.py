"""Queries of lookups, decoders, georeference and codec expressions, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import numbers as N, text as X
from ..operators import lookup as L
from ..sources import views as V

CODES = sorted(L.TAG_NAMES)


def _sql_case(column: str, values: dict, default: str = "Unknown") -> str:
    return f"CASE {column} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in values.items()) + f" ELSE '{default}' END"


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as tags: (file_id, code, value)."""
    p = V.table(spark, sf_dir, "part")
    code = F.get(F.array(*[F.lit(c) for c in [*CODES, 65000]]), (F.col("p_partkey") % (len(CODES) + 1)).cast("int"))
    return p.select(F.col("p_partkey").alias("file_id"), code.alias("code"), F.col("p_size").alias("value"))


_TAGS_SQL = f"tags AS (SELECT p_partkey AS file_id, {[*CODES, 65000]}[p_partkey % {len(CODES) + 1} + 1] AS code, p_size AS value FROM part)"


def tag_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame(list(L.TAG_NAMES.items()), "code int, name string")
    return L.named(_tags(spark, sf_dir), names, "code", "name").select("file_id", "code", "name")


def tag_interpretation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    text = F.when(c("code") == 259, L.looked_up(c("value"), L.COMPRESSIONS)).when(c("code") == 254, L.flags(c("value"), L.SUBFILE_BITS)).otherwise(c("value").cast("string"))
    return _tags(spark, sf_dir).select("file_id", "code", "value", text.alias("interpretation"))


_FLAGS_SQL = "concat_ws(', ', " + ", ".join(f"CASE WHEN value & {b} <> 0 THEN '{n}' END" for b, n in L.SUBFILE_BITS.items()) + ")"


def compact_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    hidden = spark.createDataFrame([(c,) for c in (273, 279, 324, 325, 34736, 34737)], "code int")
    return _tags(spark, sf_dir).join(hidden, "code", "left_anti").groupBy("code").agg(F.count("*").alias("n"))


def geokey_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.table(spark, sf_dir, "customer")
    n = F.length("c_name")
    directory = F.array(*[F.lit(x) for x in (1, 1, 0, 4, 1024, 0, 1)], (F.col("c_custkey") % 4 + 1).cast("int"), F.lit(1026), F.lit(L.ASCII), n + 1, F.lit(0), F.lit(2057), F.lit(L.DOUBLES), F.lit(1), F.lit(1), F.lit(3072), F.lit(0), F.lit(1), (F.col("c_custkey") % 60 + 32601).cast("int"))
    keys = L.geokeys(directory, F.array(F.lit(0.5), N.rounded_half_away(F.col("c_acctbal"), 2)), F.concat("c_name", F.lit("|rest|")))
    k = c.select(F.col("c_custkey").alias("file_id"), F.inline(keys))
    meaning = F.when(F.col("id") == 1024, L.looked_up(F.col("value").cast("int"), L.MODEL_TYPES)).when(F.col("id") == 3072, F.concat(F.lit("EPSG:"), F.col("value")))
    return k.select("file_id", "id", L.looked_up(F.col("id"), L.GEOKEYS).alias("name"), "location", "n", "value", meaning.alias("meaning"))


_GEOKEYS_SQL = """WITH k AS (SELECT c_custkey AS file_id, c_name, unnest([1024, 1026, 2057, 3072]) AS id, c_custkey, round(c_acctbal, 2) AS axis FROM customer),
v AS (SELECT file_id, id, CASE id WHEN 1026 THEN 34737 WHEN 2057 THEN 34736 ELSE 0 END AS location, CASE id WHEN 1026 THEN length(c_name) + 1 ELSE 1 END AS n,
CASE id WHEN 1024 THEN CAST(c_custkey % 4 + 1 AS VARCHAR) WHEN 1026 THEN c_name WHEN 2057 THEN CAST(axis AS VARCHAR) ELSE CAST(c_custkey % 60 + 32601 AS VARCHAR) END AS value FROM k)
SELECT file_id, id, CASE id WHEN 1024 THEN 'GTModelTypeGeoKey' WHEN 1026 THEN 'GTCitationGeoKey' WHEN 2057 THEN 'EllipsoidSemiMajorAxisGeoKey' ELSE 'ProjectedCRSGeoKey' END AS name, location, CAST(n AS INT) AS n, value,
CASE id WHEN 1024 THEN CASE value WHEN '1' THEN 'Projected' WHEN '2' THEN 'Geographic' WHEN '3' THEN 'Geocentric' ELSE 'Unknown' END WHEN 3072 THEN 'EPSG:' || value END AS meaning FROM v"""


def epsg_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lookup = V.table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), (F.col("n_nationkey") + 4000).alias("code"))
    asked = V.table(spark, sf_dir, "customer").join(V.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("OLD_"), "n_name")).when(F.col("c_custkey") % 3 == 1, F.lower("n_name")).otherwise(F.concat("n_name", F.lit("?")))
    asked = asked.select("c_custkey", name.alias("asked"))
    return L.with_fallback(asked, lookup, "asked", X.replaced(F.col("asked"), [("^old_", "")]))


def sidecar_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.table(spark, sf_dir, "supplier")
    stem = F.concat(F.lit("dir/s"), (F.col("s_suppkey")).cast("string"))
    files = s.select(F.concat(stem, F.lit(".tif")).alias("path"))
    existing = s.select(F.concat(stem, F.get(F.array(*[F.lit(x) for x in (".xml", ".tif.xml", ".txt", ".tif.aux.xml")]), (F.col("s_suppkey") % 4).cast("int"))).alias("path")).union(s.where("s_suppkey % 3 = 0").select(F.concat(stem, F.lit(".tif.xml"))))
    base = F.regexp_replace("path", r"\.tif$", "")
    return L.first_sidecar(files, existing, [F.concat("path", F.lit(".xml")), F.concat(base, F.lit(".xml")), F.concat("path", F.lit(".aux.xml")), F.concat(base, F.lit(".XML")), F.concat(base, F.lit("_metadata.xml"))])


_SIDECAR_SQL = """WITH s AS (SELECT s_suppkey AS k, 'dir/s' || s_suppkey AS stem FROM supplier), f AS (SELECT stem || '.tif' AS path, stem FROM s),
e AS (SELECT stem || ['.xml', '.tif.xml', '.txt', '.tif.aux.xml'][k % 4 + 1] AS path FROM s UNION SELECT stem || '.tif.xml' FROM s WHERE k % 3 = 0),
c AS (SELECT path, unnest([path || '.xml', stem || '.xml', path || '.aux.xml', stem || '.XML', stem || '_metadata.xml']) AS sidecar, unnest([0, 1, 2, 3, 4]) AS priority FROM f),
m AS (SELECT c.path, arg_min(sidecar, priority) AS sidecar FROM c JOIN e ON c.sidecar = e.path GROUP BY c.path) SELECT f.path, m.sidecar FROM f LEFT JOIN m USING (path)"""


def lookup_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.table(spark, sf_dir, "part")
    return L.first_of_each(p.select(F.lower("p_brand").alias("name"), F.col("p_partkey").alias("code")), "name", "code")


def lookup_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = V.table(spark, sf_dir, "nation")
    base = n.select("n_nationkey", "n_name")
    fixes = n.select((F.col("n_nationkey") * 4).alias("n_nationkey"), F.lower("n_name").alias("n_name"))
    return L.overlaid(base, fixes, "n_nationkey", "n_name")


RULES = [("automobile|machinery", "industry"), ("ing$", "things"), ("house", "home")]


def banner_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.table(spark, sf_dir, "customer")
    return L.last_match(c.select("c_custkey", "c_mktsegment"), RULES, "c_mktsegment", "banner", "none").select("c_custkey", "banner")


GT = (500000.0, 10.0, 0.0, 4_600_000.0, 0.0, -10.0)
TURNED = (100.0, 2.0, 0.5, 50.0, -0.25, -2.0)


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("file_id"), (F.col("c_custkey") * 37 % 901 + 1).alias("width"), (F.col("c_nationkey") * 91 % 701 + 1).alias("height"), (F.col("c_custkey") % 2 == 0).alias("point"), "c_acctbal", "c_name", "c_nationkey")


_IMAGES_SQL = "im AS (SELECT c_custkey AS file_id, c_custkey * 37 % 901 + 1 AS width, c_nationkey * 91 % 701 + 1 AS height, c_custkey % 2 = 0 AS point, c_acctbal, c_name, c_nationkey FROM customer)"


def native_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = _images(spark, sf_dir).select("file_id", *N.native_bbox(GT, F.col("width"), F.col("height"), F.col("point")))
    return box.withColumns({"span_x": F.col("east") - F.col("west"), "span_y": F.col("north") - F.col("south"), "center_x": (F.col("east") + F.col("west")) / 2})


def corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _images(spark, sf_dir).select("file_id", F.inline(N.corners(TURNED, F.col("width"), F.col("height"))))


def dms(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat = F.rint(F.col("c_acctbal") * 100) / 1e5
    return _images(spark, sf_dir).select("file_id", N.dms(lat, "N", "S").alias("latitude"), N.dms(lat * 2, "E", "W").alias("longitude"))


def _dms_sql(v: str, a: str, b: str) -> str:
    h = f"CAST(round_even(abs({v}) * 360000, 0) AS BIGINT)"
    return f"""({h} // 360000) || '° ' || ({h} % 360000 // 6000) || ''' ' || lpad(CAST({h} % 6000 // 100 AS VARCHAR), 2, '0') || '.' || lpad(CAST({h} % 100 AS VARCHAR), 2, '0') || '" ' || CASE WHEN {v} >= 0 THEN '{a}' ELSE '{b}' END"""


def georeference(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("file_id") % 3 != 0, F.col("c_name"))
    code = F.when(F.col("file_id") % 5 != 0, F.col("c_nationkey") + 32600)
    vertical = F.when(F.col("file_id") % 7 == 0, F.lit("EGM2008"))
    return _images(spark, sf_dir).select("file_id", X.name_and_code(name, code).alias("crs"), code.isNotNull().alias("has_code"), vertical.isNotNull().alias("has_vertical"), F.concat_ws(" + ", name, vertical).alias("compound"), F.coalesce(vertical, F.lit("none")).alias("vertical"))


#: Common vertical systems and their public EPSG codes.
VERTICAL = {"egm2008": 3855, "egm96": 5773, "navd88": 5703, "ngvd29": 5702}


def crs_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    asked = F.when(k % 5 == 0, F.concat(F.lit("EPSG:"), k + 4000)).when(k % 5 == 1, (k + 5000).cast("string")).when(k % 5 == 2, F.get(F.array(*[F.lit(x.upper()) for x in VERTICAL]), (k % 4).cast("int"))).when(k % 5 == 3, F.lit("somewhere else")).otherwise(F.lit('PROJCRS["x"]'))
    t = F.col("asked")
    code = F.coalesce(F.try_element_at(L.literal_map(VERTICAL), F.lower(t)), F.when(t.rlike("(?i)^epsg:[0-9]+$"), F.regexp_extract(t, "([0-9]+)", 1).cast("int")), F.when(t.rlike("^[0-9]+$"), t.try_cast("int")))
    kind = F.when(code.isNotNull(), "code").when(t.rlike(r"^[A-Z]+\["), "wkt").otherwise("unknown")
    return V.table(spark, sf_dir, "customer").select("c_custkey", asked.alias("asked")).select("c_custkey", "asked", code.alias("code"), kind.alias("kind"))


_CRS_SQL = f"""WITH a AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'EPSG:' || (c_custkey + 4000) WHEN 1 THEN CAST(c_custkey + 5000 AS VARCHAR) WHEN 2 THEN {[x.upper() for x in VERTICAL]}[c_custkey % 4 + 1] WHEN 3 THEN 'somewhere else' ELSE 'PROJCRS["x"]' END AS asked FROM customer),
c AS (SELECT *, CAST(CASE {" ".join(f"WHEN lower(asked) = '{k}' THEN {v}" for k, v in VERTICAL.items())} WHEN asked LIKE 'EPSG:%' THEN CAST(substr(asked, 6) AS INT) ELSE TRY_CAST(asked AS INT) END AS INT) AS code FROM a)
SELECT c_custkey, asked, code, CASE WHEN code IS NOT NULL THEN 'code' WHEN asked LIKE 'PROJCRS[%' THEN 'wkt' ELSE 'unknown' END AS kind FROM c"""


def jxl_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.explode(F.sequence(F.lit(1), F.lit(100))).alias("quality")
    d = V.table(spark, sf_dir, "region").select("r_regionkey", q).withColumn("distance", N.jxl_distance(F.col("quality")))
    return d.select("r_regionkey", "quality", "distance", N.jxl_quality(F.col("distance")).alias("back"))


def codec_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.table(spark, sf_dir, "part")
    raw = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("MAX_Z_ERROR="), (F.col("p_size") / 100).cast("string"), F.lit(" VERSION=2"))).otherwise(F.lit("VERSION=2"))
    codec = F.get(F.array(*[F.lit(x) for x in ("LZW", "DEFLATE", "ZSTD", "LERC", "JPEG")]), (F.col("p_partkey") % 5).cast("int"))
    predictor = F.when(codec.isin("LZW", "DEFLATE", "ZSTD"), F.get(F.array(F.lit("none"), F.lit("horizontal"), F.lit("floating point")), (F.col("p_size") % 3).cast("int"))).otherwise("not used")
    level = F.when(codec == "DEFLATE", 6).when(codec == "ZSTD", 9)
    z = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(raw, "MAX_Z_ERROR=([0-9.]+)", 1), F.lit("")), F.lit("9.99")).cast("double"), F.lit(0.0))
    return p.select("p_partkey", codec.alias("codec"), z.alias("max_z"), predictor.alias("predictor"), level.alias("level"), F.concat_ws("_", codec, level, F.when(predictor != "not used", F.concat(F.lit("p"), (F.col("p_size") % 3 + 1).cast("string")))).alias("file_stem"))


_PARAMS_SQL = """WITH a AS (SELECT p_partkey, p_size, ['LZW', 'DEFLATE', 'ZSTD', 'LERC', 'JPEG'][p_partkey % 5 + 1] AS codec FROM part),
b AS (SELECT *, CASE WHEN codec IN ('LZW', 'DEFLATE', 'ZSTD') THEN ['none', 'horizontal', 'floating point'][p_size % 3 + 1] ELSE 'not used' END AS predictor, CASE codec WHEN 'DEFLATE' THEN 6 WHEN 'ZSTD' THEN 9 END AS level FROM a)
SELECT p_partkey, codec, CASE WHEN p_size % 3 = 0 THEN p_size / 100.0::DOUBLE ELSE 0.0::DOUBLE END AS max_z, predictor, level, concat_ws('_', codec, level, CASE WHEN predictor <> 'not used' THEN 'p' || (p_size % 3 + 1) END) AS file_stem FROM b"""


def transparency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = V.ifds(spark, sf_dir)
    nodata = F.when(F.col("predictor") != 0, F.concat(F.lit("NoData="), (F.col("predictor") * -9999).cast("string")))
    mask = F.when(F.col("subfile").bitwiseAND(4) != 0, F.lit("Mask"))
    alpha = F.when(F.col("bands") == 3, F.lit("Alpha"))
    text = F.concat_ws(", ", alpha, mask, nodata)
    return f.select("ifd", F.when(text == "", "None").otherwise(text).alias("transparency"))


def nodata_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    f = V.ifds(spark, sf_dir).select("ifd", (c("ifd") % 3 == 0).alias("has_mask"), F.when(c("predictor") != 0, c("predictor") * -9999).alias("nodata"), F.when(c("bands") == 2, F.lit(-32767)).alias("wanted"), (c("compression") == 50000).alias("to_mask"))
    action = F.when(c("has_mask") & c("nodata").isNotNull(), "drop nodata, keep mask").when(c("to_mask") & c("nodata").isNotNull(), "make mask").when(c("wanted").isNotNull() & (c("nodata") != c("wanted")), "remap").when(c("wanted").isNotNull() & c("nodata").isNull(), "set").otherwise("keep")
    target = F.when(action.isin("remap", "set"), c("wanted")).when(action == "keep", c("nodata"))
    return f.select("ifd", action.alias("action"), target.alias("target"))


QUERIES = {
    "j01_tag_names": (tag_names, f"WITH {_TAGS_SQL} SELECT file_id, code, {_sql_case('code', L.TAG_NAMES)} AS name FROM tags"),
    "p10_tag_interpretation": (tag_interpretation, f"WITH {_TAGS_SQL} SELECT file_id, code, value, CASE code WHEN 259 THEN {_sql_case('value', L.COMPRESSIONS)} WHEN 254 THEN {_FLAGS_SQL} ELSE CAST(value AS VARCHAR) END AS interpretation FROM tags"),
    "f04_compact_tags": (compact_tags, f"WITH {_TAGS_SQL} SELECT code, count(*) AS n FROM tags WHERE code NOT IN (273, 279, 324, 325, 34736, 34737) GROUP BY code"),
    "s07_geokey_decode": (geokey_decode, _GEOKEYS_SQL),
    "j05_epsg_lookup": (epsg_lookup, """WITH a AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'OLD_' || n_name WHEN 1 THEN lower(n_name) ELSE n_name || '?' END AS asked FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, asked, coalesce(x.n_nationkey, y.n_nationkey) + 4000 AS code FROM a LEFT JOIN nation x ON lower(asked) = lower(x.n_name) LEFT JOIN nation y ON x.n_name IS NULL AND regexp_replace(lower(asked), '^old_', '') = lower(y.n_name)"""),
    "s15_sidecar_resolution": (sidecar_resolution, _SIDECAR_SQL),
    "f19_lookup_build": (lookup_build, "SELECT lower(p_brand) AS name, min(p_partkey) AS code FROM part GROUP BY 1"),
    "x39_lookup_overlay": (lookup_overlay, "SELECT coalesce(n.n_nationkey, f.n_nationkey * 4) AS n_nationkey, coalesce(lower(f.n_name), n.n_name) AS n_name FROM nation n FULL JOIN nation f ON n.n_nationkey = f.n_nationkey * 4"),
    "f18_banner_rule": (banner_rule, "SELECT c_custkey, CASE WHEN regexp_matches(c_mktsegment, '(?i)house') THEN 'home' WHEN regexp_matches(c_mktsegment, '(?i)ing$') THEN 'things' WHEN regexp_matches(c_mktsegment, '(?i)automobile|machinery') THEN 'industry' ELSE 'none' END AS banner FROM customer"),
    "p15_native_bbox": (native_bbox, f"WITH {_IMAGES_SQL}, b AS (SELECT file_id, CASE WHEN point THEN 0.5::DOUBLE ELSE 0 END AS i, width, height FROM im), c AS (SELECT file_id, 500000 + i * 10 AS west, 4600000 + (height - i) * -10 AS south, 500000 + (width - i) * 10 AS east, 4600000 + i * -10 AS north FROM b) SELECT *, east - west AS span_x, north - south AS span_y, (east + west) / 2 AS center_x FROM c"),
    "p16_corners": (corners, f"WITH {_IMAGES_SQL}, p AS (SELECT file_id, width, height, unnest(['Upper Left', 'Upper Right', 'Lower Right', 'Lower Left', 'Center']) AS corner, unnest([0, 1, 1, 0, 0.5]::DOUBLE[]) AS a, unnest([0, 0, 1, 1, 0.5]::DOUBLE[]) AS b FROM im) SELECT file_id, corner, 100 + a * width * 2 + b * height * 0.5::DOUBLE AS x, 50 + a * width * -0.25::DOUBLE + b * height * -2 AS y FROM p"),
    "x03_dms": (dms, f"WITH {_IMAGES_SQL}, v AS (SELECT file_id, round_even(c_acctbal * 100, 0) / 1e5::DOUBLE AS lat FROM im) SELECT file_id, {_dms_sql('lat', 'N', 'S')} AS latitude, {_dms_sql('(lat * 2)', 'E', 'W')} AS longitude FROM v"),
    "p18_georeference": (georeference, f"""WITH {_IMAGES_SQL}, v AS (SELECT file_id, CASE WHEN file_id % 3 <> 0 THEN c_name END AS name, CASE WHEN file_id % 5 <> 0 THEN c_nationkey + 32600 END AS code, CASE WHEN file_id % 7 = 0 THEN 'EGM2008' END AS vert FROM im)
SELECT file_id, CASE WHEN name IS NULL THEN 'EPSG:' || code WHEN code IS NULL THEN name ELSE name || ' (EPSG:' || code || ')' END AS crs, code IS NOT NULL AS has_code, vert IS NOT NULL AS has_vertical, concat_ws(' + ', name, vert) AS compound, coalesce(vert, 'none') AS vertical FROM v"""),
    "p48_crs_text": (crs_text, _CRS_SQL),
    "p24_jxl_distance": (jxl_distance, "WITH q AS (SELECT r_regionkey, CAST(unnest(generate_series(1, 100)) AS INT) AS quality FROM region), d AS (SELECT *, CASE WHEN quality >= 100 THEN 0.0::DOUBLE ELSE greatest(round_even((100 - quality) * 10::DOUBLE, 0) / 100, 0.01::DOUBLE) END AS distance FROM q) SELECT r_regionkey, quality, distance, CASE WHEN distance <= 0 THEN 'lossless' ELSE '~' || CAST(round_even(100 - distance * 10, 0) AS BIGINT) END AS back FROM d"),
    "p27_codec_params": (codec_params, _PARAMS_SQL),
    "p29_transparency_summary": (transparency_summary, f"WITH {V.IFDS_SQL} SELECT ifd, coalesce(nullif(concat_ws(', ', CASE WHEN bands = 3 THEN 'Alpha' END, CASE WHEN subfile & 4 <> 0 THEN 'Mask' END, CASE WHEN predictor <> 0 THEN 'NoData=' || (predictor * -9999) END), ''), 'None') AS transparency FROM ifds"),
    "p42_nodata_decision": (nodata_decision, f"""WITH {V.IFDS_SQL}, n AS (SELECT ifd, ifd % 3 = 0 AS has_mask, CASE WHEN predictor <> 0 THEN predictor * -9999 END AS nodata, CASE WHEN bands = 2 THEN -32767 END AS wanted, compression = 50000 AS to_mask FROM ifds),
a AS (SELECT *, CASE WHEN has_mask AND nodata IS NOT NULL THEN 'drop nodata, keep mask' WHEN to_mask AND nodata IS NOT NULL THEN 'make mask' WHEN wanted IS NOT NULL AND nodata <> wanted THEN 'remap' WHEN wanted IS NOT NULL AND nodata IS NULL THEN 'set' ELSE 'keep' END AS action FROM n)
SELECT ifd, action, CASE WHEN action IN ('remap', 'set') THEN wanted WHEN action = 'keep' THEN nodata END AS target FROM a"""),
}
