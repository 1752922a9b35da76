"""SimHash near-duplicates by tiled exact comparison (operator 8).

Fingerprints are distinct first (a group of exact copies, however large, is one row).  They
are dealt to tiles by the population counts of their four 16-bit words; two fingerprints
within the radius differ by no more than the radius in the sum of those counts' differences,
so all other pairs of tiles are skipped.  Tiles are cut into blocks of bounded size, and each
pair of blocks is one cell: numpy compares it whole by exclusive-or and bit counts.  A cell
returns the links of a spanning forest only, never all pairs of a dense group.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .components import component_labels
from .shared import written

WORDS = 4  # 16-bit words of a fingerprint; 17**4 tiles at most
BLOCK = 16_384  # fingerprints in a block of a tile
PAIRS_AT_ONCE = 4_000_000


def fingerprint(text: str, shingle_words: int = 3) -> int:
    """64-bit SimHash, as a signed integer, of the shingles of A-Z lower-cased words; zero without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) < shingle_words:
        hashes = [digest(join(words), 42)]
    else:
        hashes = [digest(join(s), 42) for s in zip(*(words[i:] for i in range(shingle_words)))]
    return majority_bits(np.array(hashes, np.uint64))


def majority_bits(hashes: np.ndarray) -> int:
    """The bits that are set in over half of some hashes, as a signed integer; zero without any."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 50_000):
        part = hashes[at : at + 50_000].astype(">u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes)).view(">i8")[0])


def with_fingerprints(df: DataFrame, text: str = "text", out: str = "fp", shingle_words: int = 3) -> DataFrame:
    """df with the fingerprint of every whole text as a signed long; null texts count as empty, a column with the name out is replaced."""

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t or "", shingle_words) for t in texts], dtype="int64")

    return df.withColumn(out, prints(F.col(text).cast("string")))


def offsets(radius: int) -> list[int]:
    """Differences of tile numbers (five bits for each word's count) that the radius allows."""
    steps = range(-radius, radius + 1)
    return [sum(d << 5 * i for i, d in enumerate(ds)) for ds in itertools.product(steps, repeat=WORDS) if sum(map(abs, ds)) <= radius]


class Forest:
    """Union-find over one cell."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return int(i)

    def add(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """Links of those pairs that join two trees."""
        roots, kept = self.root, []
        while not np.array_equal(roots, roots[roots]):
            roots = roots[roots]
        self.root = roots.copy()
        ra, rb = roots[a], roots[b]
        apart = np.flatnonzero(ra != rb)
        if apart.size:
            low, high = np.minimum(ra[apart], rb[apart]), np.maximum(ra[apart], rb[apart])
            _, first = np.unique(low * len(roots) + high, return_index=True)
            for k in apart[first]:
                x, y = self.find(int(a[k])), self.find(int(b[k]))
                if x != y:
                    self.root[max(x, y)] = min(x, y)
                    kept.append((int(a[k]), int(b[k])))
        return kept


def cell_links(low: np.ndarray, high: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest links between two blocks (within one, if high is None), as positions in low, then high."""
    other = low if high is None else high
    shift = 0 if high is None else len(low)
    forest, kept = Forest(len(low) + (0 if high is None else len(high))), []
    rows = max(1, PAIRS_AT_ONCE // max(1, len(other)))
    for at in range(0, len(low), rows):
        since = at if high is None else 0
        near = np.bitwise_count(low[at : at + rows, None] ^ other[None, since:]) <= radius
        a, b = np.nonzero(near)
        kept += forest.add(a + at, b + since + shift)
    found = np.array(kept, np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def _compare(radius: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(cells: np.ndarray, side: np.ndarray, fp: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        a, b = [], []
        edges = np.flatnonzero(np.any(cells[1:] != cells[:-1], axis=1)) + 1
        for s, e in zip([0, *edges], [*edges, len(cells)], strict=True):
            is_low = side[s:e] == 0
            here, bits = node[s:e], fp[s:e]
            low, high = bits[is_low], bits[~is_low]
            if len(high):
                i, j = cell_links(low, high, radius)
                order = np.concatenate([here[is_low], here[~is_low]])
            elif cells[s, 1] == 0 and len(low) > 1:
                i, j = cell_links(low, None, radius)
                order = here
            else:
                continue
            a.append(order[i])
            b.append(order[j])
        empty = [np.zeros(0, np.int64)]
        return pa.record_batch([pa.array(np.concatenate(a or empty)), pa.array(np.concatenate(b or empty))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("tile", "step", "block", "with_block", "side", "fp", "node")]
            now = (np.stack(cols[:4], axis=1).astype(np.int64), cols[4], cols[5].view(np.uint64), cols[6])
            if kept is not None:
                now = tuple(np.concatenate(x) for x in zip(kept, now, strict=True))
            ends = np.flatnonzero(np.any(now[0][1:] != now[0][:-1], axis=1))
            cut = int(ends[-1]) + 1 if ends.size else 0
            if cut:
                yield links(*(x[:cut] for x in now))
            kept = tuple(x[cut:] for x in now)
        if kept is not None and len(kept[0]):
            yield links(*kept)

    return run


def near_links(prints: DataFrame, radius: int = 2, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that span every group of prints (fp, node) linked within radius bits; fp must be distinct."""
    tile = sum((F.bit_count(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(0xFFFF)).cast("int") * (1 << 5 * i) for i in range(WORDS)), F.lit(0))
    dealt = prints.select("fp", "node", tile.alias("tile"))
    sizes = dealt.groupBy("tile").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))  # 17**4 rows at most
    own = dealt.join(F.broadcast(sizes), "tile").select("fp", "node", "tile", F.expr("cast(pmod(xxhash64(fp, 7), blocks) as int)").alias("mine"))
    steps = F.explode(F.array(*[F.lit(o) for o in offsets(radius)]))
    beside = own.withColumn("step", steps).withColumn("other", F.col("tile") + F.col("step"))
    beside = beside.join(F.broadcast(sizes.select(F.col("tile").alias("other"), "blocks")), "other")
    cells = beside.withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        F.least("tile", "other").alias("tile"),
        F.abs("step").alias("step"),
        F.expr("case when step > 0 then mine when step < 0 then theirs else least(mine, theirs) end").alias("block"),
        F.expr("case when step > 0 then theirs when step < 0 then mine else greatest(mine, theirs) end").alias("with_block"),
        F.expr("case when step > 0 or step = 0 and mine <= theirs then 0 else 1 end").cast("byte").alias("side"),
        "fp",
        "node",
    )
    by = ["tile", "step", "block", "with_block"]
    return cells.repartition(*by).sortWithinPartitions(*by).mapInArrow(_compare(radius), "a long, b long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 2, shingle_words: int = 3) -> DataFrame:
    """(key, fp, component_id) of every row of df; component_id: the smallest key reachable over links.

    Keys are whole numbers (others: number them first).  Fingerprints link at radius or fewer differing bits; equal ones always.  Null and empty
    texts have fingerprint zero and are linked like any other.  Rows with a null key keep
    their fingerprint and get a null component.  Repeated rows stay as they are.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    prints = written(with_fingerprints(rows, "text", "fp", shingle_words).select("key", "fp"), "prints")
    nodes = written(prints.where("key is not null").groupBy("fp").agg(F.min("key").alias("node")), "nodes")
    labels = component_labels(near_links(nodes, radius))
    resolved = nodes.join(labels, "node", "left").select("fp", F.coalesce("label", "node").alias("component_id"))
    return prints.join(resolved, "fp", "left").select(F.col("key").alias(key), "fp", F.expr("if(key is null, null, component_id)").alias("component_id"))
