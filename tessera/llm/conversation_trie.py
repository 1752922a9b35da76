"""Prefix trie of conversations from succinct level-order shards (operator 13).

numbered turns every row into a 128-bit digest with its place in the conversation; no text moves.
prefix_trie then works on sequences of digests:

* A conversation is cut into segments of SEGMENT turns; equal segments after equal beginnings are
  counted first, so a conversation that is repeated ever so often is one item.
* Items are sorted by segment, beginning and path over range partitions.  A prefix shard is a run
  of sorted items with about SHARD_NODES nodes.  In it numpy builds a LOUDS bit vector and label
  arrays; parents are read off the bits, and a pass over the levels from the lowest up sums
  members, leaves and savings with add.at.
* Nodes on the path that a shard has in common with its neighbours are the heavy upper levels.
  Every figure is a sum over shards once a node counts as new only in the first of them, which
  the common prefix of the items at the border tells; so these nodes are merged by one aggregate.
* Segments are done from the last to the first: a segment's group of items hands its sums to the
  node in which the segment before ends.  Conversations under SEGMENT turns need one round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import Sent, written

SEGMENT = 1024  # turns of an item at most
SHARD_NODES = 500_000  # of a shard, about
ID_BLOCK = 10  # bits: members of a node are listed in blocks of so many ids before they are put in line

NOTHING = hashlib.sha256(b"").hexdigest()


class LevelOrderTrie:
    """A forest by its level-order unary degrees: for the root above all and each node in level order, a 1 for every child and a 0."""

    def __init__(self, degrees: np.ndarray):
        self.size = len(degrees) - 1
        bits = np.ones(2 * self.size + 1, np.uint8)
        bits[np.cumsum(degrees) + np.arange(len(degrees))] = 0
        self.packed = np.packbits(bits)

    def bits(self) -> np.ndarray:
        return np.unpackbits(self.packed, count=2 * self.size + 1)

    def parents(self) -> np.ndarray:
        """Each node's parent in level order, -1 at the top: the k-th 1 lies in the run of as many nodes as there are 0s before it."""
        ones = np.flatnonzero(self.bits())
        return ones - np.arange(self.size) - 1

    def degrees(self) -> np.ndarray:
        """Children of each node."""
        zeros = np.flatnonzero(self.bits() == 0)
        return np.diff(zeros) - 1


def numbered(df: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, place, a, b, chars) of df's rows: places from 0 in ascending order (null first), a digest of (role, text), the text's code points.

    Null roles and texts count as empty.  Rows of one conversation and order go by role, then by
    digest; rows without a key belong to no conversation and are left out.  The order is made over
    range partitions and places are carried across their borders, so a conversation may have any length.
    """
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(order).alias("order"), r.alias("role"), F.xxhash64(r, t).alias("a"), F.xxhash64(F.lit("b"), t, r).alias("b"), F.char_length(t).cast("long").alias("chars"))
    by = ["key", F.col("order").asc_nulls_first(), "role", "a", "b"]
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by).select("key", "a", "b", "chars")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, upto, first = TaskContext.get().partitionId(), None, 0, True  # first: still in the partition's first conversation
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            n = len(keys)
            if not n:
                continue
            starts = np.flatnonzero(np.concatenate([[last is None or keys[0] != last], keys[1:] != keys[:-1]]))
            begin = np.zeros(n, np.int64)
            begin[starts] = starts
            places = np.arange(n) - np.maximum.accumulate(begin)
            places[: starts[0] if len(starts) else n] += upto
            changes = starts if last is not None else starts[1:]
            heads = np.arange(n) < (changes[0] if len(changes) else n) if first else np.zeros(n, bool)
            first, last, upto = first and not len(changes), keys[-1], int(places[-1]) + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(places), *(batch.column(i) for i in (1, 2, 3)), pa.array(np.full(n, part, np.int32)), pa.array(heads)], names=["key", "place", "a", "b", "chars", "part", "head"])

    placed = written(ordered.mapInArrow(place, "key long, place long, a long, b long, chars long, part int, head boolean"), "turns")
    # Conversations that go on from one partition to the next: one a partition at most.
    heads = {r.part: r.key for r in placed.where("head").groupBy("part").agg(F.first("key").alias("key")).collect()}
    spark = df.sparkSession
    first = spark.createDataFrame([(k,) for k in set(heads.values())], "key long")
    sizes = [(r.part, r.key, r.n) for r in placed.join(F.broadcast(first), "key").groupBy("part", "key").agg(F.count("*").alias("n")).collect()]
    carried: dict[int, int] = {}
    before: dict[int, int] = {}
    for part, k, n in sorted(sizes):
        if heads.get(part) == k and before.get(k):
            carried[part] = before[k]
        before[k] = before.get(k, 0) + n
    out = placed.select(F.col("key").alias(key), "place", "a", "b", "chars", "part", "head")
    if carried:
        offsets = F.broadcast(spark.createDataFrame(list(carried.items()), "part int, carried long"))
        out = out.join(offsets, "part", "left").withColumn("place", F.col("place") + F.when(F.col("head"), F.coalesce("carried", F.lit(0))).otherwise(0))
    return out.select(key, "place", "a", "b", "chars")


def ends_digests(ends: DataFrame) -> DataFrame:
    """(a, b, sha) of ends (a, b, id): SHA-256 of the decimal ids, ascending, with commas between.

    Ids are put together in blocks before the shuffle, and a node's blocks are hashed as they stream by in order.
    """
    blocks = ends.groupBy("a", "b", F.shiftright("id", ID_BLOCK).alias("block")).agg(F.array_join(F.sort_array(F.collect_list("id")).cast("array<string>"), ",").alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in batches:
            done: list[tuple] = []
            for a, b, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (a, b) != now:
                    if now:
                        done.append((*now, sha.hexdigest()))
                    now, sha = (a, b), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield _batch(done)
        if now:
            yield _batch([(*now, sha.hexdigest())])

    def _batch(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["a", "b", "sha"])

    return blocks.repartition("a", "b").sortWithinPartitions("a", "b", "block").select("a", "b", "ids").mapInArrow(digest, "a long, b long, sha string")


def _segments(turns: DataFrame, members: DataFrame, segment: int, rounds: int) -> DataFrame:
    """(id, seg, path, closed, sa, sb, ea, eb): each conversation's segments in order, with digests of all before and of all up to the end.

    path: an array of (place, a, b, chars), a and b now with the place in them.  The last segment of a
    conversation is under segment turns, empty where a multiple of it has gone before.
    """
    turn = F.struct("place", F.xxhash64("place", "a", "b").alias("a"), F.xxhash64("b", "a", "place").alias("b"), "chars")
    kind = "struct<place:bigint,a:bigint,b:bigint,chars:bigint>"
    rows = turns.select("id", F.floor(F.col("place") / segment).cast("long").alias("seg"), turn.cast(kind).alias("turn"))
    none = F.lit(None).cast(kind)
    rows = rows.unionByName(members.select("id", F.lit(0).cast("long").alias("seg"), none.alias("turn")))
    full = turns.where(F.col("place") % segment == segment - 1)
    rows = rows.unionByName(full.select("id", F.floor((F.col("place") + 1) / segment).cast("long").alias("seg"), none.alias("turn")))
    of = lambda c: F.coalesce(F.bit_xor(F.col("turn")[c]), F.lit(0))
    segs = rows.groupBy("id", "seg").agg(F.sort_array(F.collect_list("turn")).alias("path"), of("a").alias("xa"), of("b").alias("xb"))
    start = lambda c: F.lit(0).cast("long")
    if rounds > 1:
        before = Window.partitionBy("id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
        start = lambda c: F.coalesce(F.bit_xor(c).over(before), F.lit(0))
    segs = segs.select("id", "seg", "path", (F.size("path") < segment).alias("closed"), "xa", "xb", start("xa").alias("sa"), start("xb").alias("sb"))
    return segs.select("id", "seg", "path", "closed", "sa", "sb", F.col("sa").bitwiseXOR(F.col("xa")).alias("ea"), F.col("sb").bitwiseXOR(F.col("xb")).alias("eb"))


def common(p: Column, q: Column) -> Column:
    """Leading elements that two arrays have in common."""
    other = F.array_position(F.zip_with(p, q, lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.when(other == 0, F.size(p).cast("long")).otherwise(other - 1)


def _borders(items: DataFrame) -> tuple[int, dict[int, tuple[int, int]]]:
    """Partitions of sorted items (at, ...), and for each with rows the labels that its first and last item share with the items around.

    The group's root is the first label.  Of every partition two numbers and two items are looked at.
    """
    spans = sorted((r.part, r.low, r.high) for r in items.groupBy(F.shiftright("at", 33).cast("int").alias("part")).agg(F.min("at").alias("low"), F.max("at").alias("high")).collect())
    if not spans:
        return 0, {}
    spark = items.sparkSession
    pairs = [(i, spans[i][2], spans[i + 1][1]) for i in range(len(spans) - 1)]
    shared = {}
    if pairs:
        sides = spark.createDataFrame([(at, i, side) for i, left, right in pairs for side, at in enumerate((left, right))], "at long, border int, side int")
        ends = items.select("at", "sa", "sb", "path").join(F.broadcast(sides), "at")
        left, right = ends.where("side = 0"), ends.where("side = 1").select("border", *(F.col(c).alias(f"{c}2") for c in ("sa", "sb", "path")))
        found = left.join(right, "border").select("border", F.when((F.col("sa") == F.col("sa2")) & (F.col("sb") == F.col("sb2")), common(F.col("path"), F.col("path2")) + 1).otherwise(0).alias("n"))
        shared = {r.border: r.n for r in found.collect()}
    return spans[-1][0] + 1, {part: (shared.get(i - 1, 0), shared.get(i, 0)) for i, (part, _, _) in enumerate(spans)}


class Items:
    """Sorted items of a shard as flat arrays; each item's first label is its group's root."""

    def __init__(self, table: pa.Table):
        get = lambda c: table.column(c).combine_chunks()
        paths = get("path")
        turn = paths.flatten()
        lengths = np.diff(paths.offsets.to_numpy()) + 1
        self.n = len(lengths)
        self.off = np.concatenate([[0], np.cumsum(lengths)])
        self.item = np.repeat(np.arange(self.n), lengths)
        self.j = np.arange(self.off[-1]) - self.off[self.item]
        inner = self.j > 0
        self.a, self.b, self.chars = (np.zeros(self.off[-1], np.int64) for _ in range(3))
        for to, field, root in ((self.a, "a", "sa"), (self.b, "b", "sb"), (self.chars, "chars", None)):
            to[inner] = turn.field(field).to_numpy(zero_copy_only=False)
            if root:
                to[self.off[:-1]] = get(root).to_numpy(zero_copy_only=False)
        numbers = lambda c: get(c).fill_null(0).to_numpy(zero_copy_only=False)
        self.count, self.conv, self.closed = numbers("n"), numbers("id"), get("closed").to_numpy(zero_copy_only=False)
        self.children, self.leaves, self.saved = (numbers(f"below_{c}") for c in ("children", "leaves", "saved"))
        self.sha = get("sha")

    def common(self) -> np.ndarray:
        """Labels that each item shares with the one before it."""
        back = np.minimum(self.j + self.off[np.maximum(self.item - 1, 0)], self.off[-1] - 1)
        length = np.diff(self.off)
        same = (self.item > 0) & (self.j < length[np.maximum(self.item - 1, 0)]) & (self.a == self.a[back]) & (self.b == self.b[back])
        return np.minimum(np.minimum.reduceat(np.where(same, self.off[-1], self.j), self.off[:-1]), length)

    def prefixes(self, labels: np.ndarray) -> np.ndarray:
        """Exclusive-or of an item's labels up to each."""
        upto = np.bitwise_xor.accumulate(labels)
        return upto ^ np.where(self.item > 0, upto[np.maximum(self.off[self.item] - 1, 0)], 0)


def shard_rows(x: Items, before: int, after: int, segment: int, seg: int, shard: int) -> pa.RecordBatch:
    """A row for each node of the sorted distinct items; before, after: labels shared with the items before and after them."""
    shares, length = x.common(), np.diff(x.off)
    new = x.j >= shares[x.item]
    place = np.flatnonzero(new)  # nodes in the order of items
    depth = x.j[place]
    order = np.argsort(depth, kind="stable")  # level order
    place, level, n = place[order], depth[order], len(order)
    levels = np.concatenate([[0], np.cumsum(np.bincount(level))])
    number = np.empty(n, np.int64)
    number[order] = np.arange(n)

    # A node hangs on the last node of the level above that comes before it.
    spot = level * n + order
    above = np.searchsorted(spot, spot - n) - 1
    above[: levels[1]] = -1
    trie = LevelOrderTrie(np.bincount(above + 1, minlength=n + 1))
    parent = trie.parents()

    last = number[np.cumsum(new)[x.off[1:] - 1] - 1]  # the node that each item ends in
    fresh = np.ones(n, np.int64)
    fresh[number[:before]] = 0  # the first item's nodes come first; the shard before has them already
    members, leaves, saved, children = (np.zeros(n, np.int64) for _ in range(4))
    conv = np.full(n, np.iinfo(np.int64).max)
    members[last], conv[last] = x.count, x.conv
    extended = np.append(shares[1:] == length[:-1], after == length[-1])
    leaves[last] = np.where(x.closed, ~extended, x.leaves)
    children[last], saved[last] = x.children, x.saved
    chars = x.chars[place]
    for d in range(len(levels) - 2, -1, -1):
        at = slice(levels[d], levels[d + 1])
        saved[at] += (members[at] - fresh[at]) * chars[at]
        if d:
            up = parent[at]
            for total in (members, leaves, saved):
                np.add.at(total, up, total[at])
            np.add.at(children, up, fresh[at])
            np.minimum.at(conv, up, conv[at])

    shared = np.zeros(n, bool)
    shared[number[:before]] = True
    at = last[-1]
    while at >= 0:
        shared[at] |= level[at] < after
        at = parent[at]
    sha = np.full(n, -1)
    sha[last] = np.arange(x.n)
    pa_, pb_ = x.prefixes(x.a), x.prefixes(x.b)
    over = np.maximum(place - 1, 0)
    top = parent < 0
    columns = {
        "shard": np.full(n, shard), "a": pa_[place], "b": pb_[place], "up_a": pa_[over], "up_b": pb_[over], "depth": seg * segment + level, "root": level == 0,
        "conv_id": conv, "parent_conv_id": pa.array(conv[np.maximum(parent, 0)], mask=top), "n_convs": members, "n_children": children, "n_leaves": leaves, "saved_tokens": saved,
        "sha": x.sha.take(pa.array(sha, mask=sha < 0)), "shared": shared, "parent_shared": ~top & shared[np.maximum(parent, 0)],
    }
    return pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})


NODES = "shard long, a long, b long, up_a long, up_b long, depth long, root boolean, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, sha string, shared boolean, parent_shared boolean"


def _shared_labels(left: pa.Table, right: pa.RecordBatch) -> int:
    """Labels that left's last item shares with right's first."""
    if any(left.column(c)[-1] != right.column(c)[0] for c in ("sa", "sb")):
        return 0
    p, q = left.column("path")[-1].values, right.column("path")[0].values
    same = [np.asarray(p.field(c))[: len(q)] == np.asarray(q.field(c))[: len(p)] for c in ("a", "b")]
    differ = np.flatnonzero(~(same[0] & same[1]))
    return 1 + (int(differ[0]) if len(differ) else min(len(p), len(q)))


def shard_nodes(items: DataFrame, seg: int, segment: int, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """Rows of all shards of items (at, sa, sb, path, ...), sorted within the partitions that at tells."""
    parts, borders = _borders(items)
    sent = Sent(items.sparkSession, borders)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        nodes, shard, before, part = 0, 0, None, None

        def flush(after: int) -> pa.RecordBatch:
            return shard_rows(Items(pa.Table.from_batches(held)), before, after, segment, seg, (part << 32) + shard)

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                if part is None:
                    part = int(batch.column("at")[0].as_py()) >> 33
                    before = sent.value[part][0]
                if nodes >= shard_nodes:
                    between = _shared_labels(pa.Table.from_batches(held), batch.slice(at, 1))
                    yield flush(between)
                    held, nodes, shard, before = [], 0, shard + 1, between
                sizes = np.cumsum(pc.list_value_length(batch.column("path")).to_numpy(zero_copy_only=False)[at:] + 1)
                take = min(len(sizes), int(np.searchsorted(sizes, shard_nodes - nodes)) + 1)
                held.append(batch.slice(at, take))
                nodes, at = nodes + int(sizes[take - 1]), at + take
        if held:
            yield flush(sent.value[part][1])

    dealt = items.repartitionById(max(1, parts), F.shiftright("at", 33).cast("int")).sortWithinPartitions("at")
    return dealt.mapInArrow(build, NODES)


def prefix_trie(turns: DataFrame, members: DataFrame, segment: int = SEGMENT, nodes_of_shard: int = SHARD_NODES) -> DataFrame:
    """A row for every distinct prefix, the empty one included, of the conversations of members (id).

    turns: (id, place, a, b, chars), for each conversation places 0, 1, ...; ids that are in
    turns are in members too.  Returned per node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256 (see the query's contract).  Members are distinct; without members
    there are no rows.
    """
    most = turns.agg(F.max("place")).first()[0]
    rounds = (most + 1) // segment + 1 if most is not None else 1
    segs = written(_segments(turns, members, segment, rounds), "segments")
    ends = ends_digests(segs.where("closed").select(F.col("ea").alias("a"), F.col("eb").alias("b"), "id"))
    counted = segs.groupBy("seg", "sa", "sb", "ea", "eb").agg(F.count("*").alias("n"), F.min("id").alias("id"), F.min_by("path", "id").alias("path"), F.first("closed").alias("closed"))
    counted = counted.join(ends.select(F.col("a").alias("ea"), F.col("b").alias("eb"), "sha"), ["ea", "eb"], "left")
    by = ["seg", "sa", "sb", "path"]
    items = written(counted.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()), "items")

    below, nodes = None, []
    for seg in reversed(range(rounds)):
        own = items.where(F.col("seg") == seg)
        if below is None:
            own = own.select("*", *(F.lit(0).cast("long").alias(f"below_{c}") for c in ("children", "leaves", "saved")))
        else:  # a full path ends in the root of a group of the next segment
            got = below.select(F.col("a").alias("ea"), F.col("b").alias("eb"), F.lit(False).alias("closed"), *(F.col(c).alias(f"below_{c.split('_')[-1] if c != 'saved_tokens' else 'saved'}") for c in ("n_children", "n_leaves", "saved_tokens")), F.col("sha").alias("below_sha"))
            own = own.join(got, ["ea", "eb", "closed"], "left").withColumn("sha", F.coalesce("below_sha", "sha"))
        raw = written(shard_nodes(own.select("at", "sa", "sb", "path", "n", "id", "closed", "sha", "below_children", "below_leaves", "below_saved"), seg, segment, nodes_of_shard), "nodes")

        # Heavy upper levels: nodes of more than one shard.
        partial = raw.where("shared")
        sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
        merged = written(partial.groupBy("a", "b").agg(F.min("conv_id").alias("conv_id"), *sums, F.max("sha").alias("sha"), *(F.first(c).alias(c) for c in ("up_a", "up_b", "depth", "root"))), "upper")
        up = merged.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
        tops = merged.where("root").withColumn("parent_conv_id", F.lit(None).cast("long"))
        tops = tops.unionByName(merged.where("not root").join(up, ["up_a", "up_b"]))
        in_shard = partial.select("shard", F.col("a").alias("up_a"), F.col("b").alias("up_b")).join(up, ["up_a", "up_b"])
        hung = raw.where("not shared and parent_shared").drop("parent_conv_id").join(in_shard, ["shard", "up_a", "up_b"])
        columns = ["a", "b", "root", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "sha"]
        every = raw.where("not shared and not parent_shared").select(columns).unionByName(hung.select(columns)).unionByName(tops.select(columns))
        nodes.append(every if seg == 0 else every.where("not root"))
        below = every.where("root")
    found = nodes[0]
    for more in nodes[1:]:
        found = found.unionByName(more)
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(NOTHING)).alias("ends_sha256"))
