"""Queries of comparisons, trials, reports and text rules, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import numbers as N, text as X
from ..operators import compare as C, stats as S
from ..sources import views as V
from . import raster_queries as R


def file_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = V.table(spark, sf_dir, "orders")
    by = o.groupBy(F.col("o_custkey").alias("file_id"), F.when(F.col("o_orderstatus") == "F", "base").otherwise("comp").alias("role")).agg(F.sum(F.floor("o_totalprice")).alias("size"), F.round(F.count("*") * 1.0, 2).alias("efficiency"))
    d = C.difference(by, "file_id")
    return d.withColumn("verdict", C.verdict(F.col("delta"), F.col("percent"), F.col("eff_delta")))


_DIFF_SQL = """WITH b AS (SELECT o_custkey AS file_id, CASE WHEN o_orderstatus = 'F' THEN 'base' ELSE 'comp' END AS role, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS size, count(*)::DOUBLE AS efficiency FROM orders GROUP BY ALL),
d AS (SELECT file_id, max(size) FILTER (role = 'base') AS base_size, max(size) FILTER (role = 'comp') AS comp_size, max(efficiency) FILTER (role = 'base') AS be, max(efficiency) FILTER (role = 'comp') AS ce FROM b GROUP BY file_id),
e AS (SELECT file_id, base_size, comp_size, comp_size - base_size AS delta, round((comp_size - base_size) * 100.0::DOUBLE / base_size, 4) AS percent, round(ce - be, 4) AS eff_delta FROM d WHERE base_size IS NOT NULL AND comp_size IS NOT NULL)
SELECT *, concat_ws(', ', CASE WHEN delta < 0 THEN 'smaller by ' || abs(round(percent, 1)) || ' %' WHEN delta > 0 THEN 'larger by ' || round(percent, 1) || ' %' ELSE 'of equal size' END,
CASE WHEN eff_delta > 0.05 THEN 'better compressed' WHEN eff_delta < -0.05 THEN 'worse compressed' ELSE 'equally compressed' END) AS verdict FROM e"""


def _trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer is a file, its orders by key are the trials; the first is the baseline."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return V.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file_id"), n.alias("trial"), F.floor("o_totalprice").alias("size"), (F.col("o_orderkey") % 7).cast("double").alias("seconds"))


_TRIALS_SQL = "t AS (SELECT o_custkey AS file_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS trial, CAST(floor(o_totalprice) AS BIGINT) AS size, (o_orderkey % 7)::DOUBLE AS seconds FROM orders)"
_RATIOS_SQL = f"""WITH {_TRIALS_SQL}, r AS (SELECT file_id, trial, size, round(size / 1048576.0::DOUBLE, 6) AS size_mb, round((1 - size::DOUBLE / first_value(size) OVER w) * 100, 4) AS saved,
round(CASE WHEN first_value(seconds) OVER w = 0 THEN NULL ELSE seconds / first_value(seconds) OVER w END, 4) AS time_ratio, round(CASE WHEN seconds > 0 THEN size / 1048576.0::DOUBLE / seconds ELSE 0 END, 6) AS mb_per_s FROM t WINDOW w AS (PARTITION BY file_id ORDER BY trial ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


def trial_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.trial_ratios(_trials(spark, sf_dir))


def trial_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.trial_ranks(C.trial_ratios(_trials(spark, sf_dir))).select("file_id", "trial", "place")


def trial_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _trials(spark, sf_dir)
    per = t.groupBy("file_id").agg(F.round(F.avg("seconds"), 6).alias("mean_s"), F.round(F.stddev_samp("seconds"), 6).alias("std_s"), F.sum("seconds").alias("total_s"))
    return per.withColumn("shown", N.duration(F.col("total_s") * 97))


_TIMINGS_SQL = f"""WITH {_TRIALS_SQL}, p AS (SELECT file_id, round(avg(seconds), 6) AS mean_s, round(stddev_samp(seconds), 6) AS std_s, sum(seconds) AS total_s FROM t GROUP BY file_id), w AS (SELECT *, CAST(floor(total_s * 97) AS BIGINT) AS n FROM p)
SELECT file_id, mean_s, std_s, total_s, CASE WHEN n < 60 THEN n || 's' WHEN n < 3600 THEN (n // 60) || 'm ' || (n % 60) || 's' ELSE (n // 3600) || 'h ' || (n % 3600 // 60) || 'm ' || (n % 60) || 's' END AS shown FROM w"""

GRID = [("dem", "DEFLATE", 2), ("dem", "ZSTD", 3), ("image", "LZW", 2), ("image", "DEFLATE", 3), ("thematic", "", 1), (None, "LZW", 1)]


def trial_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file with every row of the grid (a constant list), each with its reason to be skipped and its level."""
    rows = F.inline(F.array(*[F.struct(F.lit(i).alias("trial"), F.lit(t).cast("string").alias("product"), F.lit(a).alias("algorithm"), F.lit(p).alias("predictor")) for i, (t, a, p) in enumerate(GRID, 1)]))
    c = V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file_id"), (F.col("c_custkey") % 2 == 0).alias("is_float"), rows)
    level = F.coalesce(F.when(F.col("algorithm") == "DEFLATE", 6), F.when(F.col("algorithm") == "ZSTD", 9))
    return c.select("file_id", "trial", "product", "algorithm", level.alias("level"), C.skip_reason(F.col("algorithm"), F.col("product"), F.col("predictor"), F.col("is_float")).alias("skipped"))


_GRID_SQL = "WITH g(trial, product, algorithm, predictor) AS (VALUES " + ", ".join(f"({i}, {repr(t) if t else 'NULL'}, '{a}', {p})" for i, (t, a, p) in enumerate(GRID, 1)) + """)
SELECT c_custkey AS file_id, trial, product, algorithm, CASE algorithm WHEN 'DEFLATE' THEN 6 WHEN 'ZSTD' THEN 9 END AS level,
CASE WHEN coalesce(product, '') = '' THEN 'no product type' WHEN algorithm = '' THEN 'no algorithm' WHEN predictor = 3 AND c_custkey % 2 <> 0 THEN 'predictor 3 needs floats' END AS skipped FROM customer, g"""  # fmt: skip


def stats_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = S.band_statistics(V.pixels(spark, sf_dir), "band_name").select("band_name", "minimum", "maximum", "mean", F.col("valid_count").cast("double").alias("valid_count"), F.lit(0.0).alias("nothing"))
    return C.statistics_table(stats, [n for n, _ in V.BANDS], ["minimum", "maximum", "mean", "valid_count", "nothing"])


_PIVOT_SQL = f"""WITH {V.PIXELS_SQL}, s AS (SELECT band_name, {R.STATS_SQL} FROM px GROUP BY band_name),
l AS (SELECT band_name, unnest(['minimum', 'maximum', 'mean', 'valid_count']) AS statistic, unnest([minimum, maximum, mean, valid_count::DOUBLE]) AS value FROM s)
SELECT statistic, {", ".join(f"max(value) FILTER (band_name = '{n}') AS {n}" for n, _ in V.BANDS)} FROM l GROUP BY statistic HAVING bool_or(coalesce(value, 0) <> 0)"""


def band_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.get(F.array(*[F.lit(x) for x in ("Red", "Green", "Blue", "Alpha", "NIR", "Band")]), (F.col("o_orderkey") * 7 % 6).cast("int"))
    bands = V.table(spark, sf_dir, "orders").select((F.col("o_orderkey") / 3).cast("long").alias("file_id"), (F.col("o_orderkey") % 3 + 1).cast("int").alias("band"), n.alias("name"))
    return C.band_colours(bands)


_COLOURS_SQL = f"""WITH b AS (SELECT o_orderkey // 3 AS file_id, CAST(o_orderkey % 3 + 1 AS INT) AS band, ['Red', 'Green', 'Blue', 'Alpha', 'NIR', 'Band'][o_orderkey * 7 % 6 + 1] AS name FROM orders),
n AS (SELECT *, count(*) OVER (PARTITION BY file_id, lower(name)) AS n FROM b), t AS (SELECT *, max(n > 1 AND lower(name) <> 'alpha') OVER (PARTITION BY file_id) AS twice FROM n)
SELECT file_id, band, name, CASE WHEN twice THEN {C.PALETTE}[(band - 1) % 9 + 1] ELSE coalesce(CASE lower(name) {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.BY_NAME.items())} END, {C.PALETTE}[(band - 1) % 9 + 1]) END AS colour FROM t"""

SECTIONS = [("summary", "Summary", False, False), ("tags", "Tags", False, False), ("statistics", "Statistics", False, False), ("cog", "Layout", True, False), ("crs", "Coordinate System", False, True)]


def sections_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = spark.createDataFrame(SECTIONS, "id string, title string, main_only boolean, needs_georeference boolean")
    ids = F.when(F.col("s_suppkey") % 2 == 0, F.array(*[F.lit(x) for x in ("summary", "cog", "crs", "nonsense")])).otherwise(F.array(*[F.lit(x) for x in ("crs", "statistics", "tags")]))
    asked = V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("report"), ids.alias("ids"), (F.col("s_suppkey") % 3 == 0).alias("main_page"), (F.col("s_suppkey") % 5 != 0).alias("georeferenced"))
    return C.section_plan(asked, registry)


_SECTIONS_SQL = """WITH r(id, title, main_only, geo) AS (VALUES ('summary', 'Summary', false, false), ('tags', 'Tags', false, false), ('statistics', 'Statistics', false, false), ('cog', 'Layout', true, false), ('crs', 'Coordinate System', false, true)),
a AS (SELECT s_suppkey AS report, s_suppkey % 3 = 0 AS main_page, s_suppkey % 5 <> 0 AS georeferenced, CASE WHEN s_suppkey % 2 = 0 THEN ['summary', 'cog', 'crs', 'nonsense'] ELSE ['crs', 'statistics', 'tags'] END AS ids FROM supplier),
e AS (SELECT report, main_page, georeferenced, unnest(ids) AS id, CAST(unnest(generate_series(0, len(ids) - 1)) AS INT) AS ord FROM a)
SELECT report, ord, e.id, coalesce(title, '(missing)') AS title, CASE WHEN title IS NULL THEN 'unknown' WHEN main_only AND NOT main_page THEN 'main page only' WHEN geo AND NOT georeferenced THEN 'not georeferenced' ELSE 'shown' END AS status FROM e LEFT JOIN r ON e.id = r.id"""


def markdown_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = V.table(spark, sf_dir, "nation")
    return n.groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", X.markdown_row(F.col("n_nationkey"), F.concat("n_name", F.lit(" | x")), X.grouped(F.col("n_nationkey") * 12345)).alias("row")))), lambda x: x["row"]), "\n").alias("rows"))


def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("| "), F.col("s_name"), F.lit(" ||  Citation (V 1)  | "), F.col("s_suppkey"), F.lit(" |"))
    x = F.concat(F.lit(" <a b='1'> "), F.col("s_name"), F.lit(" &\t\u0001x </a> "))
    return V.table(spark, sf_dir, "supplier").select("s_suppkey", X.clean_citation(t).alias("citation"), X.sanitized(x).alias("clean"), X.slug(t).alias("slug"), X.html_escaped(x).alias("escaped"), X.looks_like_xml(x).alias("is_xml"), X.local_name(F.concat(F.lit("{http://ns/"), "s_suppkey", F.lit("}tag"))).alias("tag"), X.replaced(F.col("s_name"), [("SUPPLIER", "Source"), ("#0*", "no. ")]).alias("renamed"))


_RULES_SQL = r"""WITH s AS (SELECT s_suppkey, s_name, '| ' || s_name || ' ||  Citation (V 1)  | ' || s_suppkey || ' |' AS t, ' <a b=''1''> ' || s_name || ' &' || chr(9) || chr(1) || 'x </a> ' AS x FROM supplier)
SELECT s_suppkey, regexp_replace(regexp_replace(regexp_replace(t, '^[\s|]+|[\s|]+$', '', 'g'), '\s*\|+\s*', '<br>', 'g'), ' +', ' ', 'g') AS citation,
replace(trim(regexp_replace(replace(x, chr(1), ''), '\s+', ' ', 'g')), '> ', '>') AS clean,
regexp_replace(regexp_replace(regexp_replace(lower(t), '\s+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '^-+|-+$', '', 'g') AS slug,
replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped, trim(x) LIKE '<%>' AS is_xml, 'tag' AS tag,
regexp_replace(regexp_replace(s_name, 'SUPPLIER', 'Source', 'gi'), '#0*', 'no. ', 'g') AS renamed FROM s"""


def array_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.sequence(F.lit(1).cast("bigint"), F.col("c_custkey") % 15 + 1)
    names = F.array(F.lit("value"), F.concat(F.lit("k"), (F.col("c_custkey") % 3).cast("string")), F.lit("name"), F.lit("b"))
    return V.table(spark, sf_dir, "customer").select("c_custkey", X.shown_array(values).alias("shown"), F.concat_ws(",", X.header_order(names)).alias("header"), F.size(N.outline(values)).alias("outline"))


_ARRAY_SQL = """WITH v AS (SELECT c_custkey, c_custkey % 15 + 1 AS n FROM customer) SELECT c_custkey, CASE WHEN n <= 8 THEN array_to_string(generate_series(1, n), ', ') ELSE '1, 2, 3, 4, 5, ... (' || n || ' values)' END AS shown, 'name,b,k' || (c_custkey % 3) || ',value' AS header, CAST(2 * n AS INT) AS outline FROM v"""


def json_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.table(spark, sf_dir, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"), F.try_parse_json("props").isNotNull().alias("is_json"))


def option_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.get(F.array(*[F.lit(x) for x in ("Yes", "off", " TRUE", "maybe", "0")]), (F.col("p_partkey") % 5).cast("int"))
    quality = F.get(F.array(*[F.lit(x) for x in ("90", "abc", "150", "1")]), (F.col("p_size") % 4).cast("int"))
    ok = F.coalesce(quality.try_cast("int").between(1, 100), F.lit(False))
    return V.table(spark, sf_dir, "part").select("p_partkey", X.as_boolean(word).alias("flag"), quality.try_cast("int").alias("quality"), ok.alias("quality_ok"), F.concat_ws("; ", F.when(~ok, F.lit("quality must be 1 to 100")), F.when(X.as_boolean(word).isNull(), F.lit("not a yes or no"))).alias("errors"))


_OPTIONS_SQL = """WITH o AS (SELECT p_partkey, ['Yes', 'off', ' TRUE', 'maybe', '0'][p_partkey % 5 + 1] AS w, ['90', 'abc', '150', '1'][p_size % 4 + 1] AS q FROM part),
b AS (SELECT p_partkey, CASE WHEN lower(trim(w)) IN ('true','t','yes','y','1','on') THEN true WHEN lower(trim(w)) IN ('false','f','no','n','0','off') THEN false END AS flag, TRY_CAST(q AS INT) AS quality FROM o)
SELECT *, coalesce(quality BETWEEN 1 AND 100, false) AS quality_ok, concat_ws('; ', CASE WHEN NOT coalesce(quality BETWEEN 1 AND 100, false) THEN 'quality must be 1 to 100' END, CASE WHEN flag IS NULL THEN 'not a yes or no' END) AS errors FROM b"""


def html_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of each page's HTML: text and target."""
    p = V.table(spark, sf_dir, "pages")
    found = F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), 1)
    return p.select("page_id", F.size(found).cast("long").alias("links"), F.size(F.array_distinct(found)).cast("long").alias("targets"), F.length(F.regexp_replace("html", r"\s+", " ")).cast("long").alias("plain_chars"))


def file_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, time and mirrored path of each file."""
    o = V.table(spark, sf_dir, "orders")
    path = F.concat(F.lit("/in/c"), F.col("o_custkey"), F.lit("/"), F.col("o_orderkey"), F.lit(".tif"))
    return o.select("o_orderkey", F.regexp_replace(path, "^/in/", "/out/").alias("target"), F.regexp_replace(path, r"\.tif$", "_report.md").alias("report"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("modified"), F.round(N.megabytes(F.floor("o_totalprice")), 4).alias("mb"))


QUERIES = {
    "j08_file_diff": (file_diff, _DIFF_SQL),
    "j09_trial_ratios": (trial_ratios, _RATIOS_SQL + " SELECT * FROM r"),
    "trial_ranks": (trial_ranks, f"WITH {_TRIALS_SQL} SELECT file_id, trial, CAST(row_number() OVER (PARTITION BY file_id ORDER BY size, trial) AS INT) AS place FROM t"),
    "a13_trial_timings": (trial_timings, _TIMINGS_SQL),
    "c11_trial_grid": (trial_grid, _GRID_SQL),
    "c17_stats_pivot": (stats_pivot, _PIVOT_SQL),
    "p44_band_colours": (band_colours, _COLOURS_SQL),
    "f07_sections_plan": (sections_plan, _SECTIONS_SQL),
    "c23_markdown_table": (markdown_table, r"""SELECT n_regionkey, string_agg('| ' || n_nationkey || ' | ' || n_name || ' \| x | ' || format('{:,}', n_nationkey * 12345) || ' |', chr(10) ORDER BY n_nationkey) AS rows FROM nation GROUP BY n_regionkey"""),
    "x22_text_rules": (text_rules, _RULES_SQL),
    "o04_array_display": (array_display, _ARRAY_SQL),
    "x59_json_path": (json_path, "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_valid(props) AS is_json FROM events"),
    "f12_option_rules": (option_rules, _OPTIONS_SQL),
    "s21_html_rows": (html_rows, r"""SELECT page_id, CAST(len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS BIGINT) AS links, CAST(len(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS BIGINT) AS targets, CAST(length(regexp_replace(html, '\s+', ' ', 'g')) AS BIGINT) AS plain_chars FROM pages"""),
    "c20_file_summary": (file_summary, "SELECT o_orderkey, '/out/c' || o_custkey || '/' || o_orderkey || '.tif' AS target, '/in/c' || o_custkey || '/' || o_orderkey || '_report.md' AS report, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS modified, round(floor(o_totalprice) / 1048576.0::DOUBLE, 4) AS mb FROM orders"),
}
