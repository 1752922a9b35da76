import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import conversation_trie as T, later_queries


def plain_trie(seqs):
    """Rows of the trie of {id: ((role, text), ...)} by the definition."""
    members, ends = {}, {}
    for c in sorted(seqs):
        ends.setdefault(seqs[c], []).append(c)
        for d in range(len(seqs[c]) + 1):
            members.setdefault(seqs[c][:d], []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids.get(p, [])) or 1
        saved[p] = sum(saved[k] for k in kids.get(p, [])) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return sorted(((m[0], len(p), members[p[:-1]][0] if p else -1, len(m), len(kids.get(p, [])), leaves[p], saved[p], sha(ends.get(p, []))) for p, m in members.items()))


def rows_of(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def trie_of(spark, seqs, **kw):
    turns = spark.createDataFrame([(c, i, r, t) for c, s in seqs.items() for i, (r, t) in enumerate(s)], "conv_id long, turn long, role string, text string").repartition(4)
    turns = T.numbered(turns).withColumnRenamed("conv_id", "id")
    return T.prefix_trie(turns, spark.createDataFrame([(c,) for c in seqs], "id long"), **kw)


def some(seed, n=120):
    rng = random.Random(seed)
    seqs = {}
    for c in rng.sample(range(-500, 5000), n):
        base = list(seqs[rng.choice(list(seqs))]) if seqs and rng.random() < 0.6 else []
        cut = rng.randrange(len(base) + 1) if rng.random() < 0.8 else len(base)
        seqs[c] = tuple(base[:cut] + [(rng.choice("ua"), rng.choice(["", "x", "yé🙂", "z" * 9])) for _ in range(rng.randrange(5))])
    return seqs


@pytest.mark.parametrize("seed,kw", [(0, {}), (1, {"nodes_of_shard": 7}), (2, {"nodes_of_shard": 25, "segment": 3}), (3, {"segment": 1, "nodes_of_shard": 40}), (4, {"segment": 2})])
def test_matches_the_definition(spark, seed, kw):
    seqs = some(seed)
    assert rows_of(trie_of(spark, seqs, **kw)) == plain_trie(seqs)


def test_hot_copies_long_and_empty_conversations(spark):
    long = tuple(("u", f"t{i}") for i in range(300))
    seqs = {i: long for i in range(400)} | {1000 + i: long[:i] for i in range(0, 300, 37)} | {2000: (), 2001: (), 3000: long + (("u", "more"),)}
    got = rows_of(trie_of(spark, seqs, nodes_of_shard=100, segment=64))
    assert got == plain_trie(seqs)
    assert rows_of(trie_of(spark, {5: ()})) == plain_trie({5: ()})
    assert trie_of(spark, {}).count() == 0


def test_places_cross_partitions(spark):
    """One conversation holds most rows and so lies in several range partitions; ties, nulls and keyless rows have their places."""
    rng = random.Random(5)
    rows = [(7, i, "u", f"{i}") for i in range(3000)] + [(k, i, "u", "x") for k in (3, 6, 8, 9) for i in range(rng.randrange(1, 60))] + [(9, None, None, None), (9, None, "b", ""), (None, 1, "u", "lost")]
    rng.shuffle(rows)
    got = T.numbered(spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, key int").repartition(6)).collect()
    assert len(got) == len(rows) - 1
    places = {}
    for r in got:
        places.setdefault(r.conv_id, []).append((r.place, r.chars))
    for k, found in places.items():
        mine = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == k))
        assert sorted(found) == [(i, len(m[3])) for i, m in enumerate(mine)], k


def test_query_rebuilds(spark, tmp_path):
    rng = random.Random(1)
    own = {}
    for c in [*range(0, 130), *range(205, 230), 300, 301, 399, 1_000_000_007]:
        own[c] = [(i, rng.choice(["user", "assistant", None]), rng.choice(["hi", "", None, "wörld"])) for i in range(rng.randrange(1, 9))]
    spark.createDataFrame([(c, *t) for c, s in own.items() for t in s], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    seqs = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = own.get(c - c % 100, [])
        seqs[c] = tuple((r or "", t or "") for _, r, t in base[:h] + own[c][h:])
    assert any(not s for s in seqs.values())
    assert rows_of(later_queries.op13_conversation_trie(spark, str(tmp_path))) == plain_trie(seqs)


def test_level_order_bits():
    trie = T.LevelOrderTrie(np.array([1, 3, 0, 2, 0, 0, 0]))
    assert "".join(map(str, trie.bits())) == "1011100110000"[:13] and trie.parents().tolist() == [-1, 0, 0, 0, 2, 2]
    assert trie.degrees().tolist() == [3, 0, 2, 0, 0, 0]


def test_ids_of_a_node_are_put_together_before_they_move(spark):
    ends = spark.createDataFrame([(1, 1, i) for i in range(-3000, 5000)] + [(2, 1, 4)], "a long, b long, id long").withColumn("id", F.col("id"))
    got = {r.a: r.sha for r in T.ends_digests(ends).collect()}
    assert got == {1: hashlib.sha256(",".join(map(str, range(-3000, 5000))).encode()).hexdigest(), 2: hashlib.sha256(b"4").hexdigest()}
