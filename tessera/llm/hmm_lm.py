"""Hidden Markov language model (operator 4).

Symbols: the end of a text, the commonest words, and for all other words one of CLASSES
classes by their first and last two bytes; a word of a class then costs its share of the
class.  Latent states are trained by Baum-Welch: every round, tasks run the scaled
forward-backward recursion over their whole training texts and give their expected counts,
which are added up across partitions.  A text's probability comes from the scaled forward
recursion over the whole text, end included.

A long text's stretches run beside each other.  The states at every border of the text are
carried forward and backward first, so what a stretch begins and ends with is what the whole
text says, and nothing is cut.  Many texts' borders are found beside each other, step by step;
in very long texts by matrices: each stretch's steps, multiplied up, are one of states x states.

Counts of all words stay in tables.  Only the HEAD commonest words reach every task; the rest
of a text's words meet their counts in a join, which no common word takes part in.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .shared import written

HEAD = 65_536  # words that are looked up in the tasks
WORD_BYTES = 64  # a longer word goes by its digest, so that a common one can be in the head too
OWN = 4_096  # of those, words with a symbol of their own
CLASSES = 512
STATES = 8
STRETCH = 512  # symbols of a long text that run one after another, beside its other stretches
LEVELS = 16  # a text of more stretches takes their matrices, as one step after another would be too many steps
EVERY = 8  # states are scaled every so many steps
SYMBOLS_AT_ONCE = 131_072  # of the stretches that run in lockstep
TEXTS_AT_ONCE = 4_194_304  # symbols of texts whose borders are found, or that are scored, together
BYTES_AT_ONCE = 4_194_304  # of texts whose words are looked up together, and half of those whose words are counted
END = b""  # no word is empty


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased words between the bytes 09-0D and 20; long ones as FF, which is in no text, and a digest of 128 bits."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if words and max(map(len, words)) > WORD_BYTES:
        words = [w if len(w) <= WORD_BYTES else digest_of(w) for w in words]
    return words


def class_of(word: bytes) -> int:
    return zlib.crc32(word[:2] + word[-2:]) % CLASSES


def digest_of(word: bytes) -> bytes:
    return b"\xff" + hashlib.md5(word, usedforsecurity=False).digest()


def pieces(texts: pa.Array, at_once: int) -> Iterator[slice]:
    """Runs of texts of about so many bytes."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // at_once)) + 1
    for begin, end in zip([0, *bounds.tolist()], [*bounds.tolist(), len(texts)], strict=True):
        if begin < end:
            yield slice(begin, end)


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """words_of texts, one text's after another's, and the place of each word's text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, owner = lists.flatten().cast(pa.binary()), np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
    sizes = pc.binary_length(words).to_numpy()
    if len(sizes) and not sizes.all():  # beside white space at a text's begin or end
        words, owner, sizes = words.filter(pa.array(sizes > 0)), owner[sizes > 0], sizes[sizes > 0]
    if (long := sizes > WORD_BYTES).any():
        digests = [digest_of(w) for w in words.filter(pa.array(long)).to_pylist()]
        words = pc.replace_with_mask(words, pa.array(long), pa.array(digests, pa.binary()))
    return words, owner


# --- counts -----------------------------------------------------------------------------


def word_counts(texts: DataFrame) -> DataFrame:
    """A written table (word, n, class) of all words, and the end, of texts (text); counts are added up in the tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in pieces(batch.column(0), 2 * BYTES_AT_ONCE):
                texts = batch.column(0)[some]
                found = pc.value_counts(words_in(texts)[0])
                word, n = pa.concat_arrays([found.field("values"), pa.array([END], pa.binary())]), pa.concat_arrays([found.field("counts"), pa.array([len(texts)])])
                yield pa.RecordBatch.from_arrays([word, n], names=["word", "n"])

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("class", pa.array([class_of(w) for w in batch.column(0).to_pylist()], pa.int32()))

    counted = texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return written(counted.mapInArrow(classed, "word binary, n long, class int"), "word-counts")


@dataclass
class Vocabulary:
    """What every task knows of the counts: the head, and sums by class."""

    head: dict[bytes, int]  # word -> place; the end has place 0
    counts: np.ndarray  # of the head
    symbols: np.ndarray  # of the head: place, or the class's symbol
    class_cost: np.ndarray  # log10 of a class's tokens + words + 1
    own: int  # symbols of single words, the end among them; the classes' follow
    total: int
    distinct: int

    @property
    def size(self) -> int:
        return self.own + CLASSES


def head_of(words: DataFrame) -> list[tuple[bytes, int]]:
    """The HEAD commonest of words (word, n), all of them if they are fewer; of equally common ones those with the least hashes.

    A top-k would bring HEAD rows from every partition to the driver.  Here the driver gets
    numbers of words: by steps of sizes, by size within the step that would be too many, by
    hash within the size that would be, each a few thousand rows; then the words themselves.
    """

    def fitting(rows: DataFrame, by: Column, room: int) -> tuple[int | None, int | None, int]:
        """Going down from the greatest value of by: the least value that still fits whole, the next one, and the room left."""
        least = None
        for r in sorted(rows.groupBy(by.alias("by")).agg(F.count("*").alias("n")).collect(), reverse=True):
            if r.n > room:
                return least, r.by, room
            least, room = r.by, room - r.n
        return least, None, room

    step = F.floor(F.log2("n") * 16).cast("int")
    turn = -F.shiftrightunsigned(F.xxhash64("word"), 48)
    taken, room, rest = F.lit(False), HEAD, words
    for by in (step, F.col("n"), turn):
        least, over, room = fitting(rest, by, room)
        within = F.lit(True) if rest is words else inside
        if least is not None:
            taken = taken | (within & (by >= least))
        if over is None:
            break
        inside = within & (by == over)
        rest = words.where(inside)
    found = sorted(((bytes(r.word), r.n) for r in words.where(taken).select("word", "n").collect()), key=lambda w: (-w[1], w[0]))
    if over is not None and room:  # words of one size and nearly one hash
        found += sorted((bytes(r.word), r.n) for r in rest.select("word", "n").collect())[:room]
    return found


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Collects HEAD words and CLASSES sums at most."""
    sums = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    words = counts.where(F.col("word") != F.lit(END))
    head = head_of(words)
    ends = counts.where(F.col("word") == F.lit(END)).agg(F.sum("n")).first()[0] or 0
    places = {END: 0} | {w: i for i, (w, _) in enumerate(head, 1)}
    numbers = np.array([ends, *(n for _, n in head)], np.int64)
    own = min(len(places), 1 + OWN)
    tokens, distinct = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counts.where(F.col("word") != F.lit(END)).groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        tokens[r["class"]], distinct[r["class"]] = r.n, r.v
    symbols = np.arange(len(places))
    for word, i in places.items():
        if 0 < i < own:  # a word with its own symbol is in no class
            tokens[class_of(word)] -= numbers[i]
            distinct[class_of(word)] -= 1
        elif i:
            symbols[i] = own + class_of(word)
    return Vocabulary(places, numbers, symbols, np.log10(tokens + distinct + 1), own, int(sums.n or 0), int(sums.v))


def encoded(df: DataFrame, vocab: Vocabulary) -> DataFrame:
    """A written table of df (key, text, held_out): the texts as symbols, what is known of them, and their rare words.

    Columns: row (a number of its own), key, held_out, n_tokens, n_known and head_log (of the
    head's words: how many have a count, and the sum of log10(count + 1)), own_log (the part
    of it of words with a symbol of their own), class_log (log10 cost of the classes), symbols,
    and the words outside the head with their numbers.
    """
    sent = df.sparkSession.sparkContext.broadcast(vocab)
    names = ["key", "held_out", "n_tokens", "n_known", "head_log", "own_log", "class_log", "symbols", "rare", "rare_n"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = sent.value
        logs = np.log10(v.counts + 1)
        own, head = v.own, pa.array([w for w, i in v.head.items() if i], pa.binary())  # the end has place 0, the first of these 1
        for batch in batches:
            for some in pieces(batch.column(0), BYTES_AT_ONCE):
                words, owner = words_in(batch.column(0)[some])
                found = pc.fill_null(pc.index_in(words, value_set=head), -2).to_numpy() + 1
                rare = words.filter(pa.array(found < 0)).dictionary_encode()
                rare_owner, rare_code, n = owner[found < 0], rare.indices.to_numpy(), some.stop - some.start
                sizes = np.bincount(owner, minlength=n) + 1
                stops = np.cumsum(sizes)
                starts = stops - sizes
                at = np.zeros(stops[-1], np.int64)
                at[np.arange(len(words)) + owner] = found
                known, symbols = at >= 0, v.symbols[at]
                symbols[~known] = own + np.array([class_of(w) for w in rare.dictionary.to_pylist()], np.int64)[rare_code]
                log, in_class = np.where(known, logs[at], 0.0), symbols >= own
                numbers = [
                    sizes,
                    np.add.reduceat((known & (v.counts[at] > 0)).astype(np.int64), starts),
                    np.add.reduceat(log, starts),
                    np.add.reduceat(np.where(at < own, log, 0.0), starts),
                    np.add.reduceat(np.where(in_class, v.class_cost[np.where(in_class, symbols - own, 0)], 0.0), starts),
                ]
                offsets = np.concatenate([[0], 2 * stops]).astype(np.int32)
                raw = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(symbols.astype("<u2"))])
                pairs, times = np.unique(rare_owner * max(1, len(rare.dictionary)) + rare_code, return_counts=True)
                row, code = np.divmod(pairs, max(1, len(rare.dictionary)))
                cuts = pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(cuts, rare.dictionary.take(pa.array(code))), pa.ListArray.from_arrays(cuts, pa.array(times, pa.int32()))]
                yield pa.RecordBatch.from_arrays([batch.column(1)[some], batch.column(2)[some], *map(pa.array, numbers), raw, *lists], names=names)

    ddl = f"key {df.schema['key'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, head_log double, own_log double, class_log double, symbols binary, rare array<binary>, rare_n array<int>"
    return written(df.select("text", "key", "held_out").mapInArrow(encode, ddl).withColumn("row", F.monotonically_increasing_id()), "encoded")


def rare_sums(table: DataFrame, counts: DataFrame) -> DataFrame:
    """(row, rare_known, rare_log): of the words outside the head, how many have a count and the sum of log10(count + 1)."""
    pairs = table.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("p")).select("row", F.col("p.rare").alias("word"), F.col("p.rare_n").alias("k"))
    met = pairs.join(counts.select("word", "n"), "word")  # words without a count add nothing
    return met.groupBy("row").agg(F.sum("k").alias("rare_known"), F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("rare_log"))


# --- hidden Markov model ----------------------------------------------------------------


@dataclass
class Model:
    first: np.ndarray  # of a text's first symbol's state
    moves: np.ndarray  # state -> state
    signs: np.ndarray  # symbol x state


def start_model(unigram: np.ndarray, states: int = STATES, seed: int = 11) -> Model:
    rng = np.random.default_rng(seed)
    signs = (unigram[:, None] + 0.1) * np.exp(rng.normal(0, 1, (len(unigram), states)))
    moves = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(moves, 0.9)
    return Model(np.full(states, 1 / states), moves / moves.sum(axis=1, keepdims=True), signs / signs.sum(axis=0))


class Lockstep:
    """Sequences side by side, the longest first: at step t the first live[t] of them have a symbol, symbols[at[t] : at[t + 1]].

    Arrays are states x sequences, so that every step works along long rows.  States are scaled
    to a sum of one at every EVERY-th step and at a sequence's last.
    """

    def __init__(self, parts: list[np.ndarray]):
        sizes = np.array([len(p) for p in parts], np.int64)
        self.order = np.argsort(-sizes, kind="stable")
        sizes = sizes[self.order]
        self.depth = int(sizes[0]) if len(sizes) else 0
        self.live = np.searchsorted(-sizes, -np.arange(self.depth + 1), side="left").tolist()
        at = np.concatenate([[0], np.cumsum(self.live)])
        self.at = at.tolist()
        if len(sizes) and sizes[0] == sizes[-1]:
            self.symbols = np.array(parts).T.astype(np.int64).ravel()
        else:
            self.symbols = np.empty(self.at[-1], np.int64)
            for place, i in enumerate(self.order.tolist()):
                self.symbols[at[: len(parts[i])] + place] = parts[i]

    def forward(self, model: Model, entry: np.ndarray, kept: bool = False) -> tuple:
        """Log probability and last scaled states of each sequence (in the order of parts); entry: expected states at each one's first symbol.

        kept: also the probabilities of the symbols, divided by the scales, and the scaled states of all steps.
        """
        signs, now, logs = np.ascontiguousarray(model.signs.T), entry[self.order].T.copy(), np.zeros(len(entry))
        moves, ones = np.ascontiguousarray(model.moves.T), np.ones(len(signs))
        moved = np.empty_like(now)
        every = signs.take(self.symbols, axis=1) if kept else None
        states = np.empty_like(every) if kept else None
        for t in range(self.depth):
            a, b, n, go_on = self.at[t], self.at[t + 1], self.live[t], self.live[t + 1]
            sign = every[:, a:b] if kept else signs.take(self.symbols[a:b], axis=1)
            here = states[:, a:b] if kept else now[:, :n]
            if t:
                np.matmul(moves, before[:, :n], out=moved[:, :n])
                np.multiply(moved[:, :n], sign, out=here)
            else:
                np.multiply(now, sign, out=here)
            scaled = 0 if t % EVERY == EVERY - 1 else go_on
            if scaled < n:
                scale = ones @ here[:, scaled:]
                here[:, scaled:] /= scale
                logs[scaled:n] += np.log(scale)
                if kept:
                    sign[:, scaled:] /= scale
                    now[:, go_on:n] = here[:, go_on:]
            before = here
        last, log = np.empty(entry.shape), np.empty(len(entry))
        last[self.order], log[self.order] = now.T, logs
        return (log, last, every, states) if kept else (log, last)

    def backward(self, model: Model, rest: np.ndarray) -> np.ndarray:
        """Relative probability of each sequence and what follows, by the state before its first symbol; rest: of what follows, by its last state."""
        signs, back = np.ascontiguousarray(model.signs.T), rest[self.order].T.copy()
        for t in range(self.depth - 1, -1, -1):
            some = back[:, : self.live[t]]
            np.matmul(model.moves, signs.take(self.symbols[self.at[t] : self.at[t + 1]], axis=1) * some, out=some)
            if t % EVERY == 0:
                some /= some.sum(axis=0)
        out = np.empty(rest.shape)
        out[self.order] = back.T
        return out


def transfers(parts: list[np.ndarray], model: Model) -> np.ndarray:
    """A matrix for each sequence, up to a factor: the probability of its symbols and its last state, by the state of its first symbol."""
    run, k = Lockstep(parts), len(model.first)
    now = np.tile(np.eye(k), (len(parts), 1, 1))
    moved = np.empty((len(parts) * k, k))
    for t in range(run.depth):
        n = run.live[t]
        here, signs = now[:n], model.signs[run.symbols[run.at[t] : run.at[t + 1]], None, :]
        if t:
            np.matmul(here.reshape(-1, k), model.moves, out=moved[: n * k])
            np.multiply(moved[: n * k].reshape(n, k, k), signs, out=here)
        else:
            here *= signs
        if t % 8 == 7 or t == run.depth - 1:
            here /= here.sum(axis=(1, 2), keepdims=True)
    out = np.empty_like(now)
    out[run.order] = now
    return out


class Stretches:
    """Texts as stretches of STRETCH symbols at most, with what their whole texts say at the borders.

    owner: the text of each; entry: expected states at its first symbol; before: scaled states
    before it, zero for a text's first; back: relative probability of the rest of the text by
    its last state.  Not backward: without back, and only very long texts are cut.
    """

    def __init__(self, texts: list[np.ndarray], model: Model, stretch: int | None = None, backward: bool = True):
        size = stretch or STRETCH
        sizes = [max(1, len(t)) if not backward and len(t) <= LEVELS * size else size for t in texts]
        self.parts = [t[i : i + n] for t, n in zip(texts, sizes, strict=True) for i in range(0, len(t), n)]
        counts = np.array([-(-len(t) // n) for t, n in zip(texts, sizes, strict=True)], np.int64)
        self.owner = np.repeat(np.arange(len(texts)), counts)
        n, k = len(self.parts), len(model.first)
        self.entry, self.before, self.back = np.tile(model.first, (n, 1)), np.zeros((n, k)), np.ones((n, k))
        self.first = np.ones(n, bool)
        starts = np.cumsum(counts) - counts
        for text, end in zip(starts.tolist(), (starts + counts).tolist()):
            self.first[text + 1 : end] = False
        self._step_by_step(starts[(counts > 1) & (counts <= LEVELS)], counts[(counts > 1) & (counts <= LEVELS)], model, backward)
        self._by_matrices(starts[counts > LEVELS], counts[counts > LEVELS], model, size)

    def _step_by_step(self, starts: np.ndarray, counts: np.ndarray, model: Model, backward: bool) -> None:
        """Borders of texts beside each other, one stretch of each after another."""
        most = int(counts.max(initial=0))
        for level in range(most - 1):
            at = starts[counts > level + 1] + level
            self.before[at + 1] = Lockstep([self.parts[i] for i in at]).forward(model, self.entry[at])[1]
            self.entry[at + 1] = self.before[at + 1] @ model.moves
        for level in range(most - 1, 0, -1) if backward else ():
            at = starts[counts > level] + level
            self.back[at - 1] = Lockstep([self.parts[i] for i in at]).backward(model, self.back[at])

    def _by_matrices(self, starts: np.ndarray, counts: np.ndarray, model: Model, size: int) -> None:
        """Borders of very long texts, whose stretches run beside each other."""
        cut, at_once = [i for a, n in zip(starts.tolist(), counts.tolist()) for i in range(a, a + n)], max(1, SYMBOLS_AT_ONCE // size)
        by = {}  # of all stretches, many texts' beside each other
        for at in range(0, len(cut), at_once):
            by |= zip(cut[at : at + at_once], transfers([self.parts[i] for i in cut[at : at + at_once]], model))
        for begin, end in zip(starts.tolist(), (starts + counts).tolist()):
            for i in range(begin, end - 1):
                after = self.entry[i] @ by[i]
                self.before[i + 1] = after / after.sum()
                self.entry[i + 1] = self.before[i + 1] @ model.moves
            for i in range(end - 1, begin, -1):
                rest = model.moves @ (by[i] @ self.back[i])
                self.back[i - 1] = rest / rest.sum()

    def groups(self, symbols: int) -> Iterator[np.ndarray]:
        """Stretches of about so many symbols and of like lengths, so memory doesn't grow with a text's length."""
        sizes = np.array([len(p) for p in self.parts], np.int64)
        order = np.argsort(-sizes, kind="stable")
        group = (np.cumsum(sizes[order]) - sizes[order]) // symbols
        yield from np.split(order, np.flatnonzero(np.diff(group)) + 1) if len(order) else ()


def forward_scores(texts: list[np.ndarray], model: Model, stretch: int | None = None) -> np.ndarray:
    """Natural log probability of each whole sequence."""
    cut, out = Stretches(texts, model, stretch, backward=False), np.zeros(len(texts))
    for some in cut.groups(TEXTS_AT_ONCE):
        np.add.at(out, cut.owner[some], Lockstep([cut.parts[i] for i in some]).forward(model, cut.entry[some])[0])
    return out


class Expected:
    """Expected counts of one round."""

    def __init__(self, symbols: int, states: int):
        self.first, self.moves, self.signs, self.log = np.zeros(states), np.zeros((states, states)), np.zeros((symbols, states)), 0.0

    def add(self, texts: list[np.ndarray], model: Model, stretch: int | None = None) -> None:
        """Scaled forward and backward recursion over whole sequences."""
        cut = Stretches(texts, model, stretch)
        for some in cut.groups(SYMBOLS_AT_ONCE):
            run = Lockstep([cut.parts[i] for i in some])
            log, _, signs, states = run.forward(model, cut.entry[some], kept=True)
            self.log += float(log.sum())
            back, moves = cut.back[some][run.order].T.copy(), np.zeros_like(self.moves)
            for t in range(run.depth - 1, -1, -1):
                a, b, n, go_on = run.at[t], run.at[t + 1], run.live[t], run.live[t + 1]
                here, step, rest = states[:, a:b], signs[:, a:b], back[:, :n]
                if go_on < n:  # the last symbol of some: the rest of their texts is scaled to their states
                    rest[:, go_on:] /= (here[:, go_on:] * rest[:, go_on:]).sum(axis=0)
                step *= rest
                here *= rest  # from here on the posterior
                if t:
                    before = run.at[t - 1]
                    moves += states[:, before : before + n] @ step.T
                    np.matmul(model.moves, step, out=rest)
                else:
                    moves += cut.before[some][run.order].T @ step.T
                    self.first += here[:, cut.first[some][run.order]].sum(axis=1)
            self.moves += moves
            for k, row in enumerate(states):
                self.signs[:, k] += np.bincount(run.symbols, row, len(self.signs))


def expected_counts(table: DataFrame, model: Model) -> Expected:
    """One round over the whole training texts: counts added up in each task, then across partitions; (symbols + states + 1) rows reach the driver."""
    symbols, states = model.signs.shape
    sent = table.sparkSession.sparkContext.broadcast(model)

    def round_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, found = sent.value, Expected(symbols, states)
        pool, held = [], 0
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                pool.append(np.frombuffer(raw, "<u2"))
                held += len(pool[-1])
                if held >= TEXTS_AT_ONCE:
                    found.add(pool, model)
                    pool, held = [], 0
        found.add(pool, model)
        rows = np.vstack([found.signs, found.moves * model.moves, found.first[None]])
        some = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(rows[some, k]) for k in range(states)), pa.array(np.where(some == some[0], found.log, 0.0) if len(some) else np.zeros(0))], names=["at", *(f"s{k}" for k in range(states)), "log"])

    sums = table.where("not held_out").select("symbols").mapInArrow(round_, ", ".join(["at int", *(f"s{k} double" for k in range(states)), "log double"]))
    total, out = np.zeros((symbols + states + 1, states)), Expected(symbols, states)
    for r in sums.groupBy("at").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(states)], F.sum("log").alias("log")).collect():
        total[r["at"]] = [r[f"s{k}"] for k in range(states)]
        out.log += r["log"]
    out.signs, out.moves, out.first = total[:symbols], total[symbols : symbols + states], total[-1]
    return out


def updated(found: Expected) -> Model:
    """The most likely model for the expected counts, each smoothed by a small constant."""
    normal = lambda x, by, axis: (x + by) / (x + by).sum(axis=axis, keepdims=True)
    return Model(normal(found.first, 0.1, 0), normal(found.moves, 0.1, 1), normal(found.signs, 0.01, 0))


def trained(table: DataFrame, vocab: Vocabulary, rounds: int = 5, states: int = STATES) -> tuple[Model, list[float]]:
    """A model after rounds of Baum-Welch over all training rows of an encoded table, and the training log10 likelihood before each round."""
    unigram = np.zeros(vocab.size)
    np.add.at(unigram, vocab.symbols[: vocab.own], vocab.counts[: vocab.own])
    unigram[vocab.own :] = 10**vocab.class_cost - 1
    model, logs = start_model(unigram, states), []
    for _ in range(rounds):
        found = expected_counts(table, model)
        logs.append(found.log / math.log(10))
        model = updated(found)
    return model, logs


def with_forward(table: DataFrame, model: Model) -> DataFrame:
    """table with hmm_log: log10 of the symbols' probability by the exact forward recursion over each whole text."""
    sent = table.sparkSession.sparkContext.broadcast(model)
    columns = ["row", "key", "held_out", "n_tokens", "n_known", "head_log", "own_log", "class_log"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            texts = [np.frombuffer(x, "<u2") for x in batch.column("symbols").to_pylist()]
            logs = forward_scores(texts, model) / math.log(10)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(logs)], names=[*columns, "hmm_log"])

    types = {f.name: f.dataType.simpleString() for f in table.schema}
    return table.select(*columns, "symbols").mapInArrow(score, ", ".join([*(f"`{c}` {types[c]}" for c in columns), "hmm_log double"]))


def hmm_scores(df: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", rounds: int = 5, states: int = STATES) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of df.

    The model learns from the rows that aren't held out (a null held_out counts as false).
    n_tokens counts the words and one end; n_known those with a count; base_score is the
    add-one unigram's log10 probability, score the hidden Markov model's.  Null and empty texts
    are an end alone.  Without any training rows every count is zero and all states are alike.
    The key keeps its type; repeated rows stay, other columns of df don't matter.
    """
    rows = df.select(F.col(text).cast("string").alias("text"), F.col(key).alias("key"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counts = word_counts(rows.where("not held_out").select("text"))
    vocab = vocabulary(counts)
    table = encoded(rows, vocab)
    model, _ = trained(table, vocab, rounds, states)
    scored = with_forward(table, model).join(rare_sums(table, counts), "row", "left")
    rare = F.coalesce("rare_log", F.lit(0.0))
    return scored.select(
        F.col("key").alias(key),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("head_log") + rare - F.col("n_tokens") * F.lit(math.log10(vocab.total + vocab.distinct + 1))).alias("base_score"),
        (F.col("hmm_log") + F.col("head_log") - F.col("own_log") + rare - F.col("class_log")).alias("score"),
    )
