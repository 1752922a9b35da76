import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import fill_in_middle as M

TEXTS = ["", None, "one line", "a\nb\n\nc", "\n", "\n\n\n", "x\n" * 3000, "é🙂\n日本\nz", "has <P> in it\nx", "a<\n<S\nb\n<", "<M>", "tab\tcr\r\nend\n", "y" * 50_000, "same\ntext\n", "same\ntext\n"]


def plain(key, text, seed, fim, spm):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b, c = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= fim:
        return key, n, "plain", None, None, text, text
    if h4 % 100 < spm:
        return key, n, "spm", len(a), len(b), text, f"<S>{c}<P>{a}<M>{b}"
    return key, n, "psm", len(a), len(b), text, f"<P>{a}<S>{c}<M>{b}"


@pytest.mark.parametrize("fim,spm", [(100, 50), (60, 100), (0, 0)])
def test_matches_the_definition(spark, fim, spm):
    rows = [(i, t) for i, t in enumerate(TEXTS * 3)] + [(7, t) for t in TEXTS] + [(None, t) for t in TEXTS] * 2 + [(3, "hot\ncopy\nrow\n")] * 200
    df = spark.createDataFrame([(k, t, 5, "x") for k, t in rows], "doc_id long, text string, N int, cut string").repartition(5)
    made = M.fill_in_middle(df, 7, fim, spm)
    got = made.withColumn("back", M.rebuilt(F.col("output"), F.col("form"))).collect()
    assert all(r.back == r.text for r in got)
    order = lambda rows: sorted(rows, key=repr)
    assert order((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.text, r.output) for r in got) == order(plain(k, t, 7, fim, spm) for k, t in rows)
    assert M.fill_in_middle(df.limit(0), 7).count() == 0


def test_other_units_and_marks(spark):
    df = spark.createDataFrame([("k1", "one two  three"), ("k2", "a b")], "doc_id string, text string")
    rows = M.fill_in_middle(df, 1, unit="\\S+\\s*", marks=("{p}", "[s]", "(m)")).withColumn("back", M.rebuilt(F.col("output"), F.col("form"), ("{p}", "[s]", "(m)"))).collect()
    assert sorted((r.doc_id, r.n, r.back) for r in rows) == [("k1", 3, "one two  three"), ("k2", 2, "a b")]
    with pytest.raises(ValueError):
        M.fill_in_middle(df, 1, marks=("<P>", "P<", "<M>"))


def test_no_cross_joins(spark, sf):
    plan = M.fill_in_middle(spark.read.parquet(f"{sf}/documents.parquet"), 7)._jdf.queryExecution().sparkPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
