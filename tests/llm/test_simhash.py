import itertools

import numpy as np
import xxhash

from tessera.llm import components, simhash


def plain_print(text, n=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else ([b" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def least_labels(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_prints_and_spark_hash(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60)
    for r in simhash.with_fingerprints(docs).collect():
        assert r.fp & (1 << 64) - 1 == plain_print(r.text)
    odd = ["", None, "One", "A b", "É x Y z", "a\x0bb\x1cc d e"]
    df = spark.createDataFrame([(t,) for t in odd], "text string")
    assert [r.fp & (1 << 64) - 1 for r in simhash.with_fingerprints(df).collect()] == [plain_print(t) for t in odd]


def test_groups_match_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(1000, None), (1001, ""), (1002, "a b"), (1003, "A B")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    prints = {k: plain_print(t) for k, t in rows}
    links = [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    assert got == least_labels(prints, links)


def test_planted_links_over_small_blocks(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.int64)
    prints = set()
    for b in base:
        for _ in range(25):
            for bit in rng.integers(0, 63, 2):
                b ^= np.int64(1) << np.int64(bit)
            prints.add(int(b))
    rows = list(enumerate(sorted(prints)))
    df = spark.createDataFrame([(p, i) for i, p in rows], "fp long, node long")
    links = simhash.near_links(df, 2, block=16)
    found = components.component_labels(links)
    got = {i: i for i, _ in rows} | {r.node: r.label for r in found.collect()}
    near = [(a, b) for (a, p), (b, q) in itertools.combinations(rows, 2) if (p ^ q).bit_count() <= 2]
    assert got == least_labels(got, near)
    assert links.count() < 2 * len(near) + len(rows)


def test_hard_tables(spark):
    df = spark.createDataFrame([(None, "a b c", 1), (5, "a b c", 2), (3, "a b c", 3), (3, "a b c", 3), (9, None, 4)], "doc_id long, text string, fp int")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(df).collect())
    assert got == [("3", "3"), ("3", "3"), ("5", "3"), ("9", "9"), ("None", "None")]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_long_chain(spark):
    n = 300
    df = spark.createDataFrame([(i, (i + 1) % n) for i in range(n)] + [(1, 1), (None, 2)], "a long, b long")
    got = {r.node: r.label for r in components.component_labels(df).collect()}
    assert got == {i: 0 for i in range(1, n)}
