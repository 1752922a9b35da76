"""Queries of WKT, XML and JSON texts made from the small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import markup as M
from ..operators import stats as S
from ..sources import views as V


def _wkt(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = V.table(spark, sf_dir, "nation")
    h = F.concat(F.lit('PROJCS["'), "n_name", F.lit(', north",GEOGCS["base",AUTHORITY["EPSG","4326"]],AUTHORITY["EPSG","'), (F.col("n_nationkey") + 32600).cast("string"), F.lit('"]]'))
    v = F.lit('VERT_CS["height",AUTHORITY["EPSG","5703"]]')
    return n.select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, M.compound_wkt(F.col("n_name"), h, v)).when(F.col("n_nationkey") % 5 == 0, F.lit("not a CRS")).otherwise(h).alias("wkt"))


def wkt_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _wkt(spark, sf_dir).withColumn("d", M.described_wkt("wkt"))
    h = d.withColumn("h", M.described_wkt("d.horizontal"))
    return h.select("n_nationkey", "d.kind", "d.name", F.col("h.code").alias("horizontal_code"), F.col("d.vertical").isNotNull().alias("has_vertical"))


_WKT_SQL = """SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'COMPD_CS' WHEN n_nationkey % 5 = 0 THEN NULL ELSE 'PROJCS' END AS kind,
CASE WHEN n_nationkey % 2 = 0 THEN n_name WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_name || ', north' END AS name,
CASE WHEN n_nationkey % 2 = 0 OR n_nationkey % 5 <> 0 THEN n_nationkey + 32600 END AS horizontal_code, n_nationkey % 2 = 0 AS has_vertical FROM nation"""


def wkt_indented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wkt(spark, sf_dir).select("n_nationkey", F.size(F.split(M.indented_wkt("wkt"), "\n")).alias("lines"), F.size(M.code_tokens("wkt")).alias("tokens"))


def xml_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested XML of regions and nations as rows."""
    n, r = V.table(spark, sf_dir, "nation"), V.table(spark, sf_dir, "region")
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.concat(F.lit('<n:item key="'), x["n_nationkey"].cast("string"), F.lit('">'), x["n_name"], F.lit("</n:item>"))), "")
    docs = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey", "r_name").agg(items.alias("items"))
    xml = docs.select("r_regionkey", F.concat(F.lit('<region xmlns:n="http://ns"><title>'), "r_name", F.lit("</title>"), "items", F.lit("</region>")).alias("xml"))
    return xml.select("r_regionkey", F.inline(M.xml_rows("xml"))).select("r_regionkey", "level", "name", "value", "attributes")


_XML_SQL = """SELECT r_regionkey, 0 AS level, 'region' AS name, NULL::VARCHAR AS value, NULL::VARCHAR AS attributes FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)
UNION ALL SELECT r_regionkey, 1, 'title', r_name, NULL FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation) UNION ALL SELECT n_regionkey, 1, 'item', n_name, '{"key": "' || n_nationkey || '"}' FROM nation"""


def well_formed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("<a><b>"), "n_name", F.when(F.col("n_nationkey") % 3 == 0, F.lit("</b></a>")).otherwise(F.lit("</a>")))
    return V.table(spark, sf_dir, "nation").select("n_nationkey", M.is_xml(t).alias("well_formed"), M.pretty_xml(t).isNotNull().alias("pretty"), M.pretty_json(F.to_json(F.struct("n_name"))).alias("json"))


def pam_sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.band_statistics(V.pixels(spark, sf_dir), "band")
    return s.select("band", M.pam_xml(F.struct("*")).alias("xml")).select("band", M.is_xml("xml").alias("well_formed"), F.size(M.xml_rows("xml")).alias("elements"), F.xpath_string("xml", F.lit("//MDI[@key='STATISTICS_MINIMUM']")).cast("double").alias("minimum"))


def significant_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "customer").select("c_custkey", M.significant(F.col("c_acctbal") / 3).alias("text"))


QUERIES = {
    "p17_wkt_description": (wkt_description, _WKT_SQL),
    "x33_wkt_indented": (wkt_indented, None),
    "x51_xml_table": (xml_table, _XML_SQL),
    "f05_well_formed": (well_formed, """SELECT n_nationkey, n_nationkey % 3 = 0 AS well_formed, n_nationkey % 3 = 0 AS pretty, '{' || chr(10) || '  "n_name": "' || n_name || '"' || chr(10) || '}' AS json FROM nation"""),
    "k04_pam_sidecar": (pam_sidecar, f"WITH {V.PIXELS_SQL} SELECT band, true AS well_formed, 7 AS elements, min(value) FILTER (NOT (is_nodata OR is_masked OR is_alpha0)) AS minimum FROM px GROUP BY band"),
    "x21_significant_digits": (significant_digits, "SELECT c_custkey, CASE WHEN c_acctbal = 0 THEN '0' ELSE format('{:.7g}', c_acctbal / 3) END AS text FROM customer"),
}
