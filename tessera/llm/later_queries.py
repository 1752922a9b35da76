"""Queries of operators 11 to 13, over their whole tables, with the SQL that must return the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import conversation_trie, fill_in_middle, url_reputation

#: (verdict, host, path)
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: A host goes if the lower bound of its share of bad pages is over BAD_LIMIT; the bound lies BAD_Z standard deviations below the mean.
BAD_LIMIT, BAD_Z = 0.3, 1.645


def op11_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the labels row with its id: bad if of low quality or toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0).alias("bad"))
    found = url_reputation.judged_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), outcomes, RULES, BAD_LIMIT, BAD_Z)
    return found.select("page_id", "host", "path", "rule", "verdict")


def _level_sql(name: str, units: str, key: str, prior: str) -> str:
    """Posterior means (mean) and weights of units (key, n, bad, prior) as a view with the concentration by moments."""
    return f"""{name}_u AS (SELECT u.*, {prior} FROM {units}),
{name}_c AS (SELECT CASE WHEN coalesce(sum(n * prior * (1 - prior) * (n - 1)), 0) <= 0 THEN 10.0
  WHEN sum((bad - n * prior) * (bad - n * prior) - n * prior * (1 - prior)) / sum(n * prior * (1 - prior) * (n - 1)) <= 1 / 10001.0 THEN 10000.0
  ELSE greatest(1.0, sum(n * prior * (1 - prior) * (n - 1)) / sum((bad - n * prior) * (bad - n * prior) - n * prior * (1 - prior)) - 1) END AS held FROM {name}_u),
{name} AS (SELECT {key}, (prior * held + bad) / (held + n) AS mean, held + n AS weight FROM {name}_u, {name}_c)"""


OP11_SQL = (
    r"""WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
o AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
h0 AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0)::DOUBLE AS bad, regexp_replace(host, '^.*@|:[0-9]*$', '', 'g') AS bare FROM p LEFT JOIN o USING (page_id) GROUP BY host),
h1 AS (SELECT *, regexp_matches(bare, '^[0-9]+(\.[0-9]+){3}$') AS number, regexp_extract(bare, '(?:^|\.)(co\.uk|org\.uk|ac\.uk|com\.au|co\.jp|co\.nz|com\.br|co\.za)$', 1) AS known FROM h0),
h2 AS (SELECT *, CASE WHEN number THEN '' WHEN known <> '' THEN known ELSE split_part(bare, '.', -1) END AS suffix FROM h1),
h AS (SELECT host, n, bad, suffix, CASE WHEN number THEN bare WHEN length(bare) <= length(suffix) + 1 THEN suffix ELSE split_part(bare[:length(bare) - length(suffix) - 1], '.', -1) || '.' || suffix END AS domain FROM h2),
"""
    + ",\n".join(
        [
            _level_sql("s", "(SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY 1) u", "suffix", "(SELECT coalesce(sum(bad) / nullif(sum(n), 0), 0) FROM h) AS prior"),
            _level_sql("d", "(SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY 1, 2) u JOIN s USING (suffix)", "domain", "s.mean AS prior"),
            _level_sql("r", "h u JOIN d USING (domain)", "host", "d.mean AS prior"),
        ]
    )
    + f""",
v AS (SELECT page_id, host, path, mean - {BAD_Z} * sqrt(mean * (1 - mean) / (weight + 1)) AS bound,
  CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
       WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
       WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
       WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
       WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM p JOIN r USING (host))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL OR bound > {BAD_LIMIT} THEN 'block' ELSE 'allow' END AS verdict FROM v"""
)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle.fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"), seed=7, fim_percent=100, spm_percent=50)
    digest = lambda c: F.sha2(c, 256)
    restored = fill_in_middle.rebuilt(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored).alias("restored_sha256"))


OP12_SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS units, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS lo, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS hi,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(units[1:lo], '') AS pre, array_to_string(units[lo + 1:hi], '') AS mid, array_to_string(units[hi + 1:], '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""


def rebuilt_turns(turns: DataFrame) -> DataFrame:
    """turns (conv_id, place, ...) of the rebuilt conversations: the first h turns of conversation conv_id - conv_id % 100, then the own turns after the first h."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    base = F.col("conv_id") - F.col("conv_id") % 100
    starts = turns.where("place < 5 and conv_id % 100 = 0")
    had = starts.groupBy(F.col("conv_id").alias("base")).agg(F.count("*").alias("had"))
    own = turns.withColumn("h", h).where("place >= h").withColumn("base", base).join(had, "base", "left")
    own = own.withColumn("place", F.expr("place - h + least(h, coalesce(had, 0))"))
    heads = turns.where("place = 0").select("conv_id", h.alias("h"), base.alias("base"))
    taken = heads.join(starts.withColumnRenamed("conv_id", "base"), "base").where("place < h")
    return own.select(turns.columns).unionByName(taken.select(turns.columns))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_trie.numbered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    members = turns.where("place = 0").select(F.col("conv_id").alias("id"))
    return conversation_trie.prefix_trie(rebuilt_turns(turns).withColumnRenamed("conv_id", "id"), members)


OP13_SQL = r"""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(flatten(list_prepend([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda s: [ascii(s)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
  lambda a, x: CASE WHEN xor(a, x) % 2 = 1 THEN xor(xor(a, x) >> 1, 3988292384::BIGINT) ELSE xor(a, x) >> 1 END), 4294967295::BIGINT) % 6 AS h FROM t),
r AS (SELECT conv_id, role, text, place AS k, 1 AS part FROM t JOIN h USING (conv_id) WHERE place >= h
  UNION ALL SELECT h.conv_id, role, text, place, 0 FROM h JOIN t ON t.conv_id = h.base WHERE place < h),
q AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, k) AS depth, role, text FROM r),
w AS (SELECT conv_id, 0 AS depth, []::STRUCT(r VARCHAR, t VARCHAR)[] AS path, 0 AS chars FROM h
  UNION ALL SELECT conv_id, depth, list({r: role, t: text}) OVER (PARTITION BY conv_id ORDER BY depth), length(text) FROM q),
n AS (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars FROM w GROUP BY 1, 2),
m AS (SELECT w.conv_id AS member, w.depth, n.conv_id FROM w JOIN n USING (depth, path)),
z AS (SELECT m.depth, m.conv_id, string_agg(member::VARCHAR, ',' ORDER BY member) AS ids FROM m JOIN (SELECT conv_id AS member, max(depth) AS depth FROM w GROUP BY 1) USING (member, depth) GROUP BY 1, 2),
b AS (SELECT n.conv_id, n.depth, n.n_convs, n.chars, up.conv_id AS parent_conv_id, up.n_convs IS NULL AS top FROM n LEFT JOIN m up0 ON up0.member = n.conv_id AND up0.depth = n.depth - 1 LEFT JOIN n up ON up.conv_id = up0.conv_id AND up.depth = up0.depth),
k AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM b WHERE NOT top GROUP BY 1, 2),
x AS (SELECT b.*, coalesce(n_children, 0) AS n_children FROM b LEFT JOIN k USING (conv_id, depth)),
s AS (SELECT m.conv_id, m.depth, sum((x.n_convs - 1) * x.chars) AS saved, count(*) FILTER (x.n_children = 0) AS leaves FROM x JOIN m ON m.member = x.conv_id AND m.depth <= x.depth GROUP BY 1, 2)
SELECT x.conv_id, x.depth::BIGINT AS depth, x.parent_conv_id, x.n_convs::BIGINT AS n_convs, x.n_children::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(z.ids, '')) AS ends_sha256
FROM x JOIN s USING (conv_id, depth) LEFT JOIN z USING (conv_id, depth)"""

QUERIES = {"op11_url_reputation": op11_url_reputation, "op12_fill_in_middle": op12_fill_in_middle, "op13_conversation_trie": op13_conversation_trie}
ORACLE_SQL = {"op11_url_reputation": OP11_SQL, "op12_fill_in_middle": OP12_SQL, "op13_conversation_trie": OP13_SQL}
