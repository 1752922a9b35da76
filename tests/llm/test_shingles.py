import itertools

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as P
from tessera.llm import shingles as S
from tessera.llm.membership import maybe_among
from tests.llm.test_simhash import least_labels

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_set(text, words=5):
    split = text.lower().split()
    return {" ".join(split[i : i + words]) for i in range(max(1, len(split) - words + 1))}


def similarity(a, b):
    return len(a & b) / len(a | b)


def stage(spark, rows):
    docs = spark.createDataFrame([(k, t, "en", "a", len(t or "")) for k, t in rows], SCHEMA)
    return sorted((r.doc_id, r.text) for r in P.near_dedup(spark, docs, "").collect())


def test_similar_texts_are_one_group(spark):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(60):
        base = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        rows.append(base)
        for edits in (1, 4, 6, 9, 20):
            near = list(base)
            for at in rng.choice(300, edits, replace=False):
                near[at] = f"e{rng.integers(0, 10**9)}"
            rows.append(near)
    rows = [(i, " ".join(r)) for i, r in enumerate(rows)]
    sets = {i: plain_set(t) for i, t in rows}
    links = [(a, b) for g in range(60) for a, b in itertools.combinations(range(6 * g, 6 * g + 6), 2) if similarity(sets[a], sets[b]) >= 0.8]
    labels = least_labels(sets, links)
    want = [i for i in sets if labels[i] == i]
    assert 60 < len(want) < 240 and [d for d, _ in stage(spark, rows)] == want


def test_given_table_against_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    sets = {d: plain_set(t) for d, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])) and similarity(sets[a], sets[b]) >= 0.8]
    labels = least_labels(sets, links)
    assert [d for d, _ in stage(spark, rows)] == sorted(d for d in sets if labels[d] == d)


def test_pairs_that_the_star_misses(spark):
    """Two of a bucket's texts are alike, its smallest node is like neither."""
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(base[:k] + [f"x{k}_{i}" for i in range(100 - k)]) for k in (70, 100)]
    texts.append(texts[1] + " more")
    sets = [S.shingle_set(t) for t in texts]
    assert [S.alike(sets[a], sets[b], 0.8) for a, b in ((0, 1), (0, 2), (1, 2))] == [False, False, True]
    assert [d for d, _ in stage(spark, enumerate(texts))] == [0, 1]


def test_long_and_empty_sets():
    long = S.shingle_set(" ".join(map(str, range(10_000))))
    assert len(long) == 9_996 and len(S.band_keys(long)) == S.BANDS and not len(S.band_keys(S.shingle_set(" ")))
    assert S.alike(long, long, 0.8) and (S.band_keys(long) == S.band_keys(S.shingle_set(" ".join(map(str, range(10_000)))))).all()


def test_unlinked_texts_under_one_id_stay(spark):
    one, two = (" ".join(f"{w}{i}" for i in range(30)) for w in "ab")
    rows = [(1, one), (5, one), (5, two), (5, two), (6, two + " more"), (7, one.upper() + " a b c d e f g h i j k l m n"), (7, two[::-1]), (None, two), (None, two)]
    docs = spark.createDataFrame([(k, t, "en", "a", 1) for k, t in rows], SCHEMA)
    got = P.near_dedup(spark, docs, "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(1, one), (5, two), rows[5], rows[6], (0, two), (0, two)])


def grouped(links, start):
    """{node: smallest label} over links and the labels the nodes start with."""
    reach = dict(start)
    for _ in reach:
        for a, b in links:
            one, other = reach[a], reach[b]
            reach = {n: min(one, other) if x in (one, other) else x for n, x in reach.items()}
    return reach


def test_blocks_of_a_bucket_against_all_pairs(spark, monkeypatch):
    """Joined labels of a bucket are those of all its pairs, whatever the size of its blocks and of the matrices."""
    rng = np.random.default_rng(5)
    sets = {}
    for n in range(60):
        sets[n] = np.unique(np.concatenate([np.setdiff1d(np.arange(20) + 100 * (n % 4), rng.integers(0, 20, rng.integers(0, 4)) + 100 * (n % 4)), rng.integers(5000, 5010, n % 3)])).astype(np.uint64)
    start = {n: n - 4 if n % 8 == 4 else n for n in sets}
    pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if S.alike(sets[a], sets[b], 0.8)]
    want = grouped(pairs, start)
    assert 4 <= len(set(want.values())) < len(set(start.values()))
    members = spark.createDataFrame([(band, n, start[n], len(s)) for band in (1, 2) for n, s in sets.items()], "band long, node long, label long, size long")
    held = spark.createDataFrame([(n, bytearray(s.tobytes())) for n, s in sets.items()], "node long, shingles binary")
    for block, shingles in ((1024, 10**6), (7, 10**6), (1024, 150)):
        links = [(r.a, r.b) for r in S.bucket_links(members, held, 0.8, block, shingles).collect()]
        assert set(map(tuple, map(sorted, links))) <= set(pairs) and grouped(links, start) == want
    monkeypatch.setattr(S, "CELLS_AT_ONCE", 200)
    found = S.cell_links(list(sets.values()), np.array([start[n] for n in sets]), len(sets), 0.8)
    assert grouped(found, start) == want and len(found) == len(set(start.values())) - len(set(want.values()))


def test_shingle_hashes_are_those_of_the_words():
    """Equal shingles, whatever the text around them and the case of A-Z, have equal hashes; others don't, in any order."""
    text = "one Two three four five six one two three four five"
    assert len(S.shingle_set(text)) == len(plain_set(text)) == 6
    assert np.isin(S.shingle_set("ONE TWO three four five"), S.shingle_set(text)).all()
    assert not np.isin(S.shingle_set("two one three four five"), S.shingle_set(text)).any()
    assert len({int(S.shingle_set(t)[0]) for t in ("a", "a a", "a b", "b a", "a b c", "a a a")}) == 6


def test_filter_lets_every_member_pass(spark):
    members = spark.range(0, 3000).select(F.xxhash64("id").alias("h"))
    rows = spark.range(0, 300_000).select("id", F.xxhash64("id").alias("h"))
    passed = {r.id for r in rows.where(maybe_among(F.col("h"), members)).collect()}
    assert set(range(3000)) <= passed and len(passed) < 3100
    assert not rows.where(maybe_among(F.col("h"), members.limit(0))).count()


def test_full_filter_changes_nothing(spark, monkeypatch):
    """A filter that lets all rows pass gives the same rows: the joins behind it decide."""
    base = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(base)), (2, " ".join(base + ["x"])), (2, " ".join(base[::-1])), (2, " ".join(base[::-1])), (3, "other words"), (None, "other words"), (4, None), (5, "")]
    once = stage_of(spark, rows)
    monkeypatch.setattr(S, "maybe_among", lambda h, members: h.isNotNull())
    assert once == stage_of(spark, rows) == sorted([(1, rows[0][1]), (2, rows[2][1]), (3, "other words"), (4, "none"), (0, "other words")])


def stage_of(spark, rows):
    docs = spark.createDataFrame([(k, t, "en", "a", 0) for k, t in rows], SCHEMA)
    return sorted((r.doc_id or 0, "none" if r.text is None else r.text) for r in P.near_dedup(spark, docs, "").collect())


def test_templates_cost_their_size(spark):
    """Texts of one template at a similarity of 0.7 share a bucket; what is compared grows with their number, not its square, and planted pairs are found."""

    def cells(n):
        rng = np.random.default_rng(n)
        sets = {i: np.unique(np.concatenate([np.arange(100), rng.integers(1000, 2**62, 21)])).astype(np.uint64) for i in range(n)}
        for i in range(0, n, 50):  # alike to the next one, in all but two shingles
            sets[i] = np.unique(np.concatenate([sets[i + 1][:-2], rng.integers(1000, 2**62, 2).astype(np.uint64)]))
        members = spark.createDataFrame([(7, i, i, len(s)) for i, s in sets.items()], "band long, node long, label long, size long")
        held = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in sets.items()], "node long, shingles binary")
        links = {tuple(sorted((r.a, r.b))) for r in S.bucket_links(members, held, 0.8, 100, 10**6).collect()}
        assert links == {(i, i + 1) for i in range(0, n, 50)}
        crowd = members.select("node", "label", "size").join(held, "node").select("node", "label", "size", "shingles")
        finer = S.postings(crowd, 0.8)
        return S.cells_of(finer, S._uneven(finer, 100, 10**6), held).count()

    few, many = cells(500), cells(1000)
    assert 0 < many < 2.5 * few and many < 1000
