"""Line deduplication by a suffix array over line-ID sequences (operator 1).

Every text is a sequence of line IDs.  Distributed prefix doubling ranks the suffixes by
their first 1, 2, 4, ... lines: the rank of twice the lines comes from sorting the pairs of
ranks at a place and as many lines further on.  Suffixes that no other suffix agrees with drop
out of each round, so the table shrinks as the depth grows.

A repeated run counts if it has at least min_words words.  Any line of such a run lies in a
window of the run that has no line to spare: the shortest window of min_words words that begins
at some line, or the shortest that ends at this line.  The suffixes that agree on a window's
lines are an interval of the suffix array with that common prefix; two ranks of a power of two,
one from the window's begin and one up to its end, name the interval.  The first window of an
interval in the order of (key, line) stays, later ones are deleted; deleted windows that meet
make up the maximal run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import written

#: Lines of a text that can be told apart in a place; texts have fewer.
LINES = 1 << 28


def shortest_windows(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines of the shortest window of least words that begins, and that ends, at each line; 0: there is none."""
    ends = np.cumsum(words)
    before = ends - words
    last = np.searchsorted(ends, before + least, side="left")
    ahead = np.where(last < len(words), last - np.arange(len(words)) + 1, 0)
    first = np.searchsorted(before, ends - least, side="right") - 1
    back = np.where(ends >= least, np.arange(len(words)) - first + 1, 0)
    return ahead, back


def line_rows(docs: DataFrame, least: int) -> DataFrame:
    """(row, seq, line, id, words, ahead, back) of the lines with words of docs (row, text); id: a 128-bit digest of the line."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
                counts = [len(x.split()) for x in lines]
                at = [i for i, n in enumerate(counts) if n]
                words = np.array([counts[i] for i in at], np.int64)
                ahead, back = shortest_windows(words, least)
                for column, x in zip(out, ([row] * len(at), range(len(at)), at, [hashlib.md5(lines[i], usedforsecurity=False).digest() for i in at], words.tolist(), ahead.tolist(), back.tolist()), strict=True):
                    column.extend(x)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["row", "seq", "line", "id", "words", "ahead", "back"])

    return docs.select("row", "text").mapInArrow(rows, "row long, seq long, line long, id binary, words long, ahead long, back long")


def ranked(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """df, whose columns by are distinct, with its place in their order: a range-partitioned sort and the partitions' offsets."""
    order = df.orderBy(*by).select(*df.columns, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_at"))
    order = written(order, "ranks")
    sizes = order.groupBy("_part").agg((F.max("_at") + 1).alias("n"))  # a row for each partition
    offsets = sizes.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    return order.join(F.broadcast(offsets), "_part").select(*df.columns, (F.col("_offset") + F.col("_at")).alias(name))


def doubled(ranks: DataFrame, lines: int) -> DataFrame:
    """(at, rank) by twice as many lines, of the places where another place agrees; ranks: (at, rank) by lines lines."""
    further = ranks.select((F.col("at") - lines).alias("at"), F.col("rank").alias("then"))
    pairs = written(ranks.join(further, "at"), "pairs")
    repeated = pairs.groupBy("rank", "then").agg(F.count("*").alias("n")).where("n > 1").select("rank", "then")
    named = ranked(repeated, ["rank", "then"], "name")
    return written(pairs.join(named, ["rank", "then"]).select("at", F.col("name").alias("rank")), "doubled")


def later_windows(lines: DataFrame, least: int) -> DataFrame:
    """(at, lines): windows without a line to spare that an earlier window equals; lines: (at, id, ahead, back)."""
    repeated = lines.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    named = ranked(repeated, ["id"], "rank")
    places = written(lines.join(named, "id").select("at", "rank", "ahead", "back"), "places")
    begins = places.where("ahead > 0").select("at", F.col("ahead").alias("lines"))
    ends = places.where("back > 0").select((F.col("at") - F.col("back") + 1).alias("at"), F.col("back").alias("lines"))
    windows = written(begins.unionByName(ends).distinct(), "windows")
    ranks, depth, found = places.select("at", "rank"), 1, None
    while depth <= least:  # a line has a word at least, so no window has more lines than words
        here = windows.where((F.col("lines") >= depth) & (F.col("lines") < 2 * depth))
        named = here.join(ranks, "at").join(ranks.select(F.col("at").alias("second"), F.col("rank").alias("then")), F.expr(f"at + lines - {depth}") == F.col("second"))
        named = written(named.select("at", "lines", "rank", "then"), "intervals")
        first = named.groupBy("lines", "rank", "then").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
        first = written(first, "first")  # both sides of the join have an exchange of their own, so a large interval can be split
        later = named.join(first, ["lines", "rank", "then"]).where("at > first").select("at", "lines")
        found = later if found is None else found.unionByName(later)
        if 2 * depth > least:
            break
        ranks, depth = doubled(ranks, depth), 2 * depth
        if ranks.isEmpty():
            break
    return found


def deduplicated_lines(df: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 50) -> DataFrame:
    """(key, text, n_lines, deleted, runs) of every row of df.

    text: the whole text without the later copies of repeated runs of at least min_words words
    (lines end at line feeds; blank lines belong to no run and stay); deleted: the numbers, from
    0, of the deleted lines; runs: (first, last) line number of each maximal deleted run, blank
    lines inside a run aside.  Copies are ordered by key, nulls last, and line; among rows of
    equal keys one is the earlier.  The key may be of any type that sorts.  Null texts stay null
    and have no lines; lines are equal if all their bytes are.
    """
    docs = written(df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id()), "docs")
    order = ranked(docs.select(F.col("key").isNull().alias("none"), "key", "row"), ["none", "key", "row"], "doc").select("row", "doc")
    lines = written(line_rows(docs, min_words).join(order, "row").select((F.col("doc") * LINES + F.col("seq")).alias("at"), "row", "line", "id", "ahead", "back"), "lines")
    gone = later_windows(lines, min_words)
    gone = gone.select(F.explode(F.sequence(F.col("at"), F.col("at") + F.col("lines") - 1)).alias("at")).distinct()
    marked = lines.select("at", "row", "line").join(gone, "at")
    by_row = Window.partitionBy("row").orderBy("at")
    starts = marked.withColumn("new", F.when(F.col("at") == F.lag("at").over(by_row) + 1, 0).otherwise(1))
    islands = starts.withColumn("run", F.sum("new").over(by_row)).groupBy("row", "run").agg(F.sort_array(F.collect_list("line")).alias("lines"), F.min("line").alias("first"), F.max("line").alias("last"))
    by_doc = islands.groupBy("row").agg(F.sort_array(F.flatten(F.collect_list("lines"))).alias("deleted"), F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))
    empty = F.array().cast("array<bigint>")
    joined = docs.join(by_doc, "row", "left").select("key", "text", F.coalesce("deleted", empty).alias("deleted"), F.coalesce("runs", F.array().cast("array<struct<first:bigint,last:bigint>>")).alias("runs"))
    return joined.select(F.col("key").alias(key), kept_lines(F.col("text"), F.col("deleted")).alias("text"), F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long").alias("n_lines"), "deleted", "runs")


def kept_lines(text: Column, deleted: Column) -> Column:
    """text without the lines of deleted, which are in order: the stretches between them, so the cost is that of the text."""

    def stretches(lines: Column, gone: Column) -> Column:
        cuts = F.concat(F.array(F.lit(-1).cast("bigint")), gone, F.array(F.size(lines).cast("bigint")))
        # Arguments of a lambda are evaluated once; an expression inside it would be for each element.
        between = F.transform(F.array(F.struct(cuts.alias("cuts"), lines.alias("lines"))), lambda x: F.flatten(F.transform(F.arrays_zip(F.slice(x["cuts"], F.lit(1), F.size(x["cuts"]) - 1), F.slice(x["cuts"], F.lit(2), F.size(x["cuts"]) - 1)), lambda c: F.slice(x["lines"], (c["0"] + 2).cast("int"), (c["1"] - c["0"] - 1).cast("int")))))
        return F.get(between, F.lit(0))

    bound = F.transform(F.array(F.struct(F.split(text, "\n", -1).alias("lines"), deleted.alias("gone"))), lambda x: stretches(x["lines"], x["gone"]))
    return F.when(F.size(deleted) == 0, text).otherwise(F.array_join(F.get(bound, F.lit(0)), "\n"))
