import random

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tessera.llm import line_dedup as L, queries


def brute(docs, least):
    """{key: deleted line numbers} straight from the definition."""
    seqs = []
    for k, t in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)):
        lines = (t or "").split("\n")
        seqs.append((k, [(i, x, len(x.split())) for i, x in enumerate(lines) if x.split()]))
    places = [(n, i) for n, (_, s) in enumerate(seqs) for i in range(len(s))]
    out = {k: set() for k, _ in seqs}
    for x, (n, i) in enumerate(places):
        longest = 0
        for m, j in places[:x]:
            a, b, same = seqs[n][1][i:], seqs[m][1][j:], 0
            while same < min(len(a), len(b)) and a[same][1] == b[same][1]:
                same += 1
            longest = max(longest, same)
        run = seqs[n][1][i : i + longest]
        if sum(w for _, _, w in run) >= least:
            out[seqs[n][0]].update(p for p, _, _ in run)
    return {k: sorted(v) for k, v in out.items()}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 9), max_size=30), st.integers(1, 25))
def test_shortest_windows(words, least):
    ahead, back = L.shortest_windows(np.array(words, np.int64), least)
    for i in range(len(words)):
        want = next((e - i for e in range(i + 1, len(words) + 1) if sum(words[i:e]) >= least), 0)
        assert ahead[i] == want
        want = next((i + 1 - s for s in range(i, -1, -1) if sum(words[s : i + 1]) >= least), 0)
        assert back[i] == want


def check(spark, docs, least):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {r.doc_id: r for r in L.deduplicated_lines(df, min_words=least).collect()}
    want = brute(docs, least)
    texts = dict(docs)
    for k, r in rows.items():
        assert r.deleted == want[k], k
        if texts[k] is None:
            assert r.text is None and r.n_lines == 0
        else:
            lines = texts[k].split("\n")
            assert r.n_lines == len(lines) and r.text == "\n".join(x for i, x in enumerate(lines) if i not in set(want[k]))
        assert [i for a, b in r.runs for i in range(a, b + 1) if i in set(r.deleted)] == r.deleted
    return want


def test_against_definition(spark):
    rng = random.Random(2)
    pool = [" ".join(["w%d" % rng.randrange(50)] * rng.randrange(1, 6)) for _ in range(12)]
    docs = []
    for k in range(40):
        lines = [rng.choice(pool) if rng.random() < 0.9 else "own %d %d" % (k, i) for i in range(rng.randrange(1, 12))]
        if docs and rng.random() < 0.5:
            other = docs[rng.randrange(len(docs))][1].split("\n")
            at = rng.randrange(len(other))
            lines[1:1] = other[at : at + rng.randrange(2, 8)]
        if rng.random() < 0.3:
            lines.insert(rng.randrange(len(lines) + 1), " ")
        docs.append((k, "\n".join(lines)))
    docs += [(90, None), (91, ""), (92, "\n\n"), (None, docs[3][1])]
    want = check(spark, docs, 8)
    assert sum(map(len, want.values())) > 50 and not want[90]


def test_long_repeats_and_whole_copies(spark):
    line = "one two three"
    docs = [(1, "\n".join([line] * 60)), (2, "\n".join(f"line {i} here" for i in range(70))), (3, "\n".join(f"line {i} here" for i in range(5, 70)) + "\nnew"), (4, "\n".join([line] * 3))]
    check(spark, docs, 20)


def test_hard_tables(spark, sf):
    df = spark.createDataFrame([(3, "a b c\nd e f", 1), (3, "a b c\nd e f", 1), (None, "a b c\nd e f", 2)], "doc_id long, text string, deleted int")
    rows = L.deduplicated_lines(df, min_words=4).collect()
    assert sorted((str(r.doc_id), r.text) for r in rows) == [("3", ""), ("3", "a b c\nd e f"), ("None", "")]
    assert L.deduplicated_lines(df.limit(0)).count() == 0
    found = queries.op1_line_dedup(spark, sf)
    assert found.count() == 200 and found.agg(F.sum("n_deleted")).first()[0] > 0


def test_query_matches_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = duckdb.sql(queries.OP1_SQL)
    found = queries.op1_line_dedup(spark, sf)
    assert found.columns == want.columns
    assert sorted(map(tuple, found.collect())) == sorted(want.fetchall())
