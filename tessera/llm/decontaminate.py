"""Benchmark decontamination by pigeonhole edit matching (operator 6).

A test item of m characters may occur with up to k = m * rate edits.  Cut into k + 1 pieces,
at least one piece then occurs unchanged, so all occurrences are near exact piece hits.  One
automaton finds the pieces of a block of items in a single pass over each whole text; only the
stretches around hits are verified, by Myers' bit-parallel edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import Sent, kept_by

ITEMS_AT_ONCE = 10_000  # items of one automaton, and their characters; more take more passes over the texts
CHARACTERS_AT_ONCE = 8_000_000
LEAST = 16  # characters of an item, normalised: shorter ones stand in clean texts by chance


def normalised(text: str | None) -> str:
    """Lower case, white space runs as one space."""
    return " ".join((text or "").lower().split())


def budget(length: int, rate: float) -> int:
    return min(int(length * rate), max(0, length - 1))


def pieces(item: str, rate: float) -> list[tuple[int, str]]:
    """(offset, piece) of budget + 1 pieces of nearly equal length."""
    n = budget(len(item), rate) + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def best_end(pattern: str, text: str) -> tuple[int, int]:
    """(distance, end) of the occurrence of pattern in text with the fewest edits; the first of equals."""
    m = len(pattern)
    mask, high = (1 << m) - 1, 1 << (m - 1)
    at: dict[str, int] = {}
    for i, c in enumerate(pattern):
        at[c] = at.get(c, 0) | 1 << i
    plus, minus, score, best, end = mask, 0, m, m, 0
    for j, c in enumerate(text, 1):
        eq = at.get(c, 0)
        xv = eq | minus
        xh = ((eq & plus) + plus ^ plus) | eq
        ph = minus | mask & ~(xh | plus)
        mh = plus & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best, end = score, j
                if not best:
                    break
        ph, mh = ph << 1 & mask, mh << 1 & mask
        plus, minus = mh | mask & ~(xv | ph), ph & xv
    return best, end


class Matcher:
    """The pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple], rate: float, least: int = LEAST):
        import ahocorasick

        self.items = [(k, t) for k, t in ((k, normalised(t)) for k, t in items) if len(t) >= max(1, least)]
        self.rate = rate
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text) in enumerate(self.items):
            for offset, piece in pieces(text, rate):
                where.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def matches(self, text: str | None) -> list[tuple]:
        """(item, distance, begin, end) of the best occurrence of each item within its budget; places are those of the normalised text."""
        if not self.items or not (plain := normalised(text)):
            return []
        stretches: dict[int, list[list[int]]] = {}
        for last, (size, places) in self.automaton.iter(plain):
            for n, offset in places:
                length = len(self.items[n][1])
                k = budget(length, self.rate)
                begin = max(0, last + 1 - size - offset - k)
                end = min(len(plain), begin + length + 2 * k + 1)
                known = stretches.setdefault(n, [])
                if known and begin <= known[-1][1] and begin >= known[-1][0]:
                    known[-1][1] = max(known[-1][1], end)
                else:
                    known.append([begin, end])
        found = []
        for n, known in sorted(stretches.items()):
            key, item = self.items[n]
            k, best = budget(len(item), self.rate), None
            for begin, end in merged(known):
                distance, stop = best_end(item, plain[begin:end])
                if distance <= k and (best is None or distance < best[0]):
                    # The begin is where the reversed item ends in the reversed text before the end.
                    from_ = max(0, begin + stop - len(item) - k)
                    _, back = best_end(item[::-1], plain[from_ : begin + stop][::-1])
                    best = (distance, begin + stop - back, begin + stop)
            if best:
                found.append((key, *best))
        return found


def merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return out


def matcher(sent: Sent) -> Matcher:
    """This worker's automaton for a block of items; one is kept at a time."""
    kept = kept_by("decontaminate")
    if sent.id not in kept:
        kept.clear()
        kept[sent.id] = Matcher(*sent.value)
    return kept[sent.id]


def item_blocks(items: DataFrame, item_key: str, item_text: str) -> Iterator[list[tuple]]:
    """The items with a key and a text in blocks bounded by number and characters; one empty block if there are none."""
    block, held, blocks = [], 0, 0
    for key, text in items.where(F.col(item_key).isNotNull() & F.col(item_text).isNotNull()).select(item_key, item_text).toLocalIterator():
        if block and (len(block) >= ITEMS_AT_ONCE or held + len(text) > CHARACTERS_AT_ONCE):
            yield block
            block, held, blocks = [], 0, blocks + 1
        block.append((key, text))
        held += len(text)
    if block or not blocks:
        yield block


def holds_none(sent: Sent):
    """A filter for texts without any item of a broadcast (items, rate, least)."""

    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        found = matcher(sent)
        for texts in batches:
            yield pd.Series([not found.matches(t) for t in texts], dtype=bool)

    return clean


def uncontaminated(df: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", rate: float = 0.08, least: int = LEAST) -> DataFrame:
    """The rows of df, with all their columns, whose whole text holds no test item within its budget (see contaminated); null and empty texts stay."""
    for block in item_blocks(items, item_key, item_text):
        df = df.where(holds_none(Sent(df.sparkSession, (block, rate, least)))(F.col(text).cast("string")))
    return df


def contaminated(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", rate: float = 0.08, least: int = LEAST) -> DataFrame:
    """(key, item_id, distance, begin, end): the best occurrence of every test item in every whole text, within rate edits a character.

    Of an item that a text holds more than once, only the occurrence with the fewest edits, the
    first of equals, has a row.  begin and end are places of the normalised text.  Keys of texts
    and items keep their types.  Null or empty texts, and items of
    under least characters, match nothing; equal items and
    repeated rows each have their own rows; rows come back whatever their key, null too.  Other
    columns of df don't matter.  Items are read in blocks, each of which is matched against all
    texts; no text is moved.
    """
    spark = df.sparkSession
    source = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    types = source.schema["key"].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    item_type = to_arrow_type(items.schema[item_key].dataType)
    found = None
    for block in item_blocks(items, item_key, item_text):
        sent = Sent(spark, (block, rate, least))

        def match(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            by = matcher(sent)
            for batch in batches:
                texts = batch.column(1).to_pylist()
                out = [(i, *m) for i, t in enumerate(texts) for m in by.matches(t)]
                keys = batch.column(0).take(pa.array([r[0] for r in out], pa.int64()))
                numbers = [pa.array([r[i] for r in out], pa.int64()) for i in (2, 3, 4)]
                yield pa.RecordBatch.from_arrays([keys, pa.array([r[1] for r in out], item_type), *numbers], names=["key", "item_id", "distance", "begin", "end"])

        part = source.mapInArrow(match, f"key {types[0]}, item_id {types[1]}, distance long, begin long, end long")
        found = part if found is None else found.unionByName(part)
    return found.withColumnRenamed("key", key)
