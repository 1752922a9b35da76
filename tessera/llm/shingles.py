"""Operator 8 at a similarity of word shingles instead of a radius (second stage of the pipeline).

Texts with the same set of shingles are one node.  Nodes get a SimHash fingerprint, and the
operator's tiled exact comparison (see simhash) links those within its radius; every link is
verified on the shingles themselves.  A similarity of 0.8 reaches further than tiles can (such
fingerprints differ in some ten bits), so further candidates share a band of MinHash values,
and are verified likewise.  Each band's bucket is first a star around its smallest node.  The
buckets whose nodes these links leave in different components are then compared whole: a cell
counts all its common shingles by a matrix product and returns only links that join components.
So no pairs are written and a dense group of copies costs its size.  Nodes of a bucket of more
than a block (texts of one template) are compared only with those that share a rare shingle and
could be alike by size and place (a prefix filter, exact), in blocks if these are still many.
Whole texts are shuffled only if they may be like another one (see membership).
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .components import component_labels
from .membership import maybe_among
from .shared import Sent, fresh, kept_by, looked_up, written
from .simhash import Forest, majority_bits, near_links

BANDS, IN_BAND = 24, 5  # a pair at similarity s shares a band with probability 1 - (1 - s**5)**24: 0.9999 at 0.8
AT_ONCE = 4096  # shingles hashed at a time
BLOCK, BLOCK_SHINGLES = 1024, 2_000_000  # nodes, and shingles, of a block of a bucket, about
SLOTS = 1 << 20  # counters of shingles, which put them in order
CELLS_AT_ONCE = 8_000_000  # entries of an incidence matrix at a time
_RANDOM = np.random.default_rng(8)
_TIMES, _PLUS = (_RANDOM.integers(0, 2**64, (BANDS * IN_BAND, 1), np.uint64) for _ in range(2))
_TIMES |= np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)  # the golden ratio's bits
_MIX = _RANDOM.integers(0, 2**64, (BANDS, IN_BAND), np.uint64) | np.uint64(1)


@functools.cache
def _places(words: int) -> np.ndarray:
    """An odd factor for each place of a shingle."""
    return np.random.default_rng(5).integers(0, 2**64, words, np.uint64) | np.uint64(1)


def shingle_set(text: str, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the shingles of A-Z lower-cased words; of all words, if they are fewer.

    A shingle's hash mixes the sum of its words' hashes, each times the factor of its place.
    """
    split = text.encode("utf-8", "surrogatepass").lower().split()
    if not split:
        return np.zeros(0, np.uint64)
    hashed, words = np.frombuffer(b"".join(map(xxhash.xxh64_digest, split)), ">u8").astype(np.uint64), min(words, len(split))
    n = len(hashed) - words + 1
    x = np.zeros(n, np.uint64)
    for i, factor in enumerate(_places(words)):
        x += hashed[i : i + n] * factor
    for _ in range(2):
        x ^= x >> np.uint64(32)
        x *= _ODD
    x = np.sort(x ^ (x >> np.uint64(32)))
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A key for each band of MinHash values of a set; none for an empty one."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * IN_BAND, 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), AT_ONCE):
        least = np.minimum(least, (shingles[None, at : at + AT_ONCE] * _TIMES + _PLUS).min(axis=1))
    return (least.reshape(BANDS, IN_BAND) * _MIX).sum(axis=1, dtype=np.uint64).view(np.int64)


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets' Jaccard similarity reaches the bound."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose shingles (node, shingles) are alike."""

    @F.pandas_udf("boolean")
    def holds(first: pd.Series, second: pd.Series) -> pd.Series:
        return pd.Series([alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), similarity) for x, y in zip(first, second)], dtype="bool")

    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("second")).hint("merge"), "b")
    both = both.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("first")).hint("merge"), "a")
    return written(both.where(holds("first", "second")).select("a", "b"), "alike")


def cell_links(sets: list[np.ndarray], labels: np.ndarray, low: int, similarity: float) -> list[tuple[int, int]]:
    """Positions of alike sets that span what links between labels allow.

    The first low sets are compared with the others, or with each other if there are no others.
    """
    n, sizes = len(sets), np.array([len(x) for x in sets], np.int64)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    at = np.repeat(np.arange(n), sizes)[shared]
    _, column = np.unique(column[shared], return_inverse=True)
    order = np.argsort(column, kind="stable")
    at, column = at[order], column[order]
    since = 0 if low == n else low
    common = np.zeros((low, n - since), np.float32)  # whole numbers below 2**24 are exact
    width = max(1, CELLS_AT_ONCE // n)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        s, e = np.searchsorted(column, [start, start + width])
        held = np.zeros((n, min(width, int(column[-1]) + 1 - start)), np.float32)
        held[at[s:e], column[s:e] - start] = 1
        common += held[:low] @ held[since:].T
    both = common.astype(np.float64)
    near = both >= similarity * (sizes[:low, None] + sizes[None, since:] - both) - 1e-9
    near &= labels[:low, None] != labels[None, since:]
    a, b = np.nonzero(near)
    forest = Forest(n)
    _, first, label = np.unique(labels, return_index=True, return_inverse=True)
    forest.root = first[label]
    return forest.add(a, b + since)


def _uneven(members: DataFrame, block: int, block_shingles: int) -> DataFrame:
    """(band, blocks) of the buckets of members (band, node, label, size) with more than one label; buckets of the same nodes count as one."""
    h = F.xxhash64("node")
    buckets = members.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n"), F.sum("size").alias("shingles"), F.bit_xor(h).alias("x"), F.min(h).alias("least"), F.max(h).alias("most"))
    buckets = buckets.where("low < high").groupBy("n", "x", "least", "most", "shingles").agg(F.min("band").alias("band"))
    return buckets.select("band", F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("shingles") / block_shingles)).cast("int").alias("blocks"))


def cells_of(members: DataFrame, cuts: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows of every pair of blocks of the buckets of cuts (band, blocks), with their shingles."""
    dealt = members.join(cuts.hint("merge"), "band").withColumn("mine", F.expr("cast(pmod(xxhash64(node, band), blocks) as int)"))
    dealt = dealt.join(sets.hint("merge"), "node").withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("band", F.least("mine", "theirs").alias("block"), F.greatest("mine", "theirs").alias("with_block"), (F.col("mine") > F.col("theirs")).alias("second"), "node", "label", "shingles")


def _compared(cells: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between labels within each cell."""

    def links(cell: pa.Table) -> pa.Table:
        cell = cell.sort_by("second")
        node, labels = cell["node"].to_numpy(), cell["label"].to_numpy()
        low = len(node) - int(np.count_nonzero(cell["second"].to_numpy()))
        alone = cell["block"][0] == cell["with_block"][0]
        found = []
        if low and (alone or low < len(node)) and (labels != labels[0]).any():
            found = cell_links([np.frombuffer(x.as_buffer(), np.uint64) for x in cell["shingles"]], labels, low, similarity)
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": node[pairs[:, 0]], "b": node[pairs[:, 1]]})

    return cells.groupBy("band", "block", "with_block").applyInArrow(links, "a long, b long")


def postings(crowd: DataFrame, similarity: float) -> DataFrame:
    """(band, node, label, size): the nodes of crowd (node, label, size, shingles) that share a rare shingle and may be alike.

    Shingles are put in one order for all nodes, rare ones first.  Of two alike sets the
    shorter has one of its first size - 2s/(1+s) size + 1 shingles among the first
    size - s size + 1 of the longer one, and behind it both have as many as they must share.
    How rare a shingle is comes from counts in SLOTS slots; any order gives the same links,
    and this one leaves out what all texts of a template have in common.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for x in batch.column(0):
                np.add.at(total, (np.frombuffer(x.as_buffer(), np.uint64) % np.uint64(SLOTS)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"slot": at, "n": total[at]})

    found = crowd.select("shingles").mapInArrow(counted, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SLOTS, np.int64)
    counts[found["slot"].to_numpy()] = found["n"].to_numpy()
    sent = Sent(crowd.sparkSession, counts)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(6)]
            for node, label, x in zip(*(batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)), batch.column(2), strict=True):
                x = np.frombuffer(x.as_buffer(), np.uint64)
                size = len(x)
                n = size - int(np.ceil(similarity * size - 1e-9)) + 1
                first = x[np.lexsort((x, sent.value[(x % np.uint64(SLOTS)).astype(np.int64)]))[:n]].view(np.int64)
                n = len(first)
                index = size - int(np.ceil(2 * similarity / (1 + similarity) * size - 1e-9)) + 1
                for column, v in zip(out, (first, np.full(n, node), np.full(n, label), np.full(n, size), size - np.arange(n), np.arange(n) < index), strict=True):
                    column.append(v)
            empty = [np.zeros(0, np.int64)]
            columns = [np.concatenate(c or empty) for c in out]
            columns[5] = columns[5].astype(bool)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["band", "node", "label", "size", "left", "short"])

    rows = written(crowd.select("node", "label", "shingles").mapInArrow(prefixes, "band long, node long, label long, size long, left long, short boolean"), "prefixes")
    short = lambda f, c: f(F.when(F.col("short"), F.col(c)))
    shared = rows.groupBy("band").agg(F.count("*").alias("rows"), F.min("label").alias("low"), F.max("label").alias("high"), short(F.min, "size").alias("least"), short(F.max, "size").alias("most"))
    shared = written(shared.where("low < high and least is not null").select("band", "rows", "least", "most"), "shared")
    near = looked_up(rows, shared, "band", "rows")
    must = 2 * similarity / (1 + similarity) / 2
    return near.where((F.col("left") >= must * (F.col("size") + F.col("least")) - 1e-6) & (similarity * F.col("size") <= F.col("most") + 1e-6)).select("band", "node", "label", "size")


def bucket_links(members: DataFrame, sets: DataFrame, similarity: float, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Links (a, b) that join the labels of every bucket of members (band, node, label, size); sets: (node, shingles).

    A bucket of one block is compared whole.  The nodes of larger ones are gathered once, and those that share a rare
    shingle (see postings) are compared instead: texts of one template that aren't alike cost their size.
    """
    cuts = written(_uneven(members, block, block_shingles), "buckets")
    found = written(_compared(cells_of(members, cuts.where("blocks = 1"), sets), similarity), "joining")
    large = cuts.where("blocks > 1")
    if large.isEmpty():
        return found
    crowd = members.join(large.select("band").hint("merge"), "band").groupBy("node").agg(F.first("label").alias("label"), F.first("size").alias("size"))
    crowd = written(crowd.join(sets.hint("merge"), "node"), "crowd")
    finer = written(postings(crowd, similarity), "postings")
    return written(found.unionByName(_compared(cells_of(finer, _uneven(finer, block, block_shingles), crowd.select("node", "shingles")), similarity)), "joining")


def _groups(df: DataFrame, key: str, text: str, similarity: float, shingle_words: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """(key, text_hash) of every row with a key, and of the one text of every group that stays."""

    @F.pandas_udf("fp long, bits long, size long, bands array<bigint>")
    def signed(texts: pd.Series) -> pd.DataFrame:
        kept_by("shingles")
        sets = [shingle_set(t or "", shingle_words) for t in texts]
        fp = np.array([xxhash.xxh64_intdigest(s.tobytes()) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
        return pd.DataFrame({"fp": fp, "bits": np.array([majority_bits(s) for s in sets], np.int64), "size": np.array([len(s) for s in sets], np.int64), "bands": [band_keys(s) for s in sets]})

    @F.pandas_udf("binary")
    def shingles_of(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t or "", shingle_words).tobytes() for t in texts], dtype=object)

    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("text_hash", text_hash(F.col("text")))
    prints = written(rows.select("key", "text_hash", signed("text").alias("s")).select("key", "text_hash", "s.fp", "s.bits", "s.size", "s.bands"), "prints")
    nodes = written(prints.groupBy(F.col("fp").alias("node")).agg(F.min(F.struct("key", "text_hash")).alias("least"), F.first("bits").alias("bits"), F.first("size").alias("size"), F.first("bands").alias("bands")), "nodes")

    filled = nodes.where(F.size("bands") > 0)  # the empty text is like no other
    heads = written(filled.groupBy(F.col("bits").alias("fp")).agg(F.min("node").alias("node"), F.count("*").alias("n")), "fingerprints")
    same = filled.join(heads.where("n > 1").select(F.col("fp").alias("bits"), F.col("node").alias("head")).hint("merge"), "bits").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    tiled = written(near_links(heads.select("fp", "node"), radius).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(same), "tiles")

    dealt = nodes.select("node", "size", F.explode("bands").alias("band"))
    leaders = dealt.groupBy("band").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    buckets = written(dealt.join(leaders.hint("merge"), "band"), "buckets")
    asked = buckets.select("node").union(tiled.select("a")).union(tiled.select("b")).distinct()
    inside = written(asked.join(nodes.select("node", "least.*"), "node"), "inside")
    # Texts that no other text may be like don't move.
    wanted = rows.where(maybe_among(F.xxhash64("key", "text_hash"), inside.select(F.xxhash64("key", "text_hash")))).dropDuplicates(["key", "text_hash"])
    sets = written(wanted.join(inside.hint("merge"), ["key", "text_hash"]).select("node", shingles_of("text").alias("shingles")), "sets")

    stars = buckets.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b"))
    stars = written(stars.unionByName(tiled).distinct(), "pairs")
    links = _verified(stars, sets, similarity)
    labelled = buckets.join(component_labels(links), "node", "left").select("band", "node", F.coalesce("label", "node").alias("label"), "size")
    links = links.unionByName(bucket_links(written(labelled, "members"), sets, similarity))

    grouped = nodes.select("node", "least").join(component_labels(links), "node", "left")
    return prints.select("key", "text_hash"), grouped.groupBy(F.coalesce("label", "node").alias("component")).agg(F.min("least").alias("least")).select("least.key", "least.text_hash")


def without_near_copies(df: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = 0.8, shingle_words: int = 5, radius: int = 2) -> DataFrame:
    """The rows of df, with all their columns, but for one text, that with the smallest key, of every group of texts linked by similar pairs.

    Texts decide, not keys: texts under one key that nothing links all stay, rows of equal key
    and text count as one.  Rows with a null key are in no group and stay.  Null texts count as
    empty, and all empty ones are one group.  Only rows that may go or repeat are moved.
    """
    prints, keep = _groups(df, key, text, similarity, shingle_words, radius)
    keep = written(keep, "keep")
    counted = prints.groupBy("key", "text_hash").agg(F.count("*").alias("n"))
    odd = counted.join(keep.withColumn("stays", F.lit(True)).hint("merge"), ["key", "text_hash"], "left").where("n > 1 or stays is null")
    hashed = text_hash(F.col(text))
    doubtful = F.col(key).isNotNull() & maybe_among(F.xxhash64(F.col(key), hashed), odd.select(F.xxhash64("key", "text_hash")))
    own = fresh("text_hash", df.columns)
    once = df.where(doubtful).withColumn(own, hashed).dropDuplicates([key, own])
    stay = once.join(keep.select(F.col("key").alias(key), F.col("text_hash").alias(own)).hint("merge"), [key, own], "left_semi")
    return df.where(~doubtful).unionByName(stay.select(*df.columns))
