"""Token counts by a compiled finite-state tokenizer (operator 2).

Two deterministic transducers run one after the other over every text.

1. *Splitter.*  Ten states over twelve character classes find where the byte-level
   splitting pattern starts a new piece.  It runs over fixed blocks of characters: every
   block is first reduced to its state map (entry state -> exit state), the maps are
   composed by a parallel prefix scan, and only then does each block emit its piece starts
   from its own, now known, entry state.  No block waits for the block before it.

2. *Merger.*  Within a piece, byte-pair merges become a deterministic transducer over
   bytes.  A state holds what the future can still ask of the past: for every suffix of the
   piece read so far that begins some vocabulary entry, the last token before that suffix
   and how many tokens stood there.  Reading a byte moves to the next state and emits the
   change of the token count, so the counts along a path add up to the tokens of the piece.
   States are compiled when they are first reached and kept for the worker's life; all
   pieces of a block of texts advance through the table in lockstep.

Why one last token per suffix is enough: a merge result is exactly the segmentation whose
neighbouring tokens are pairwise stable (joining the two alone gives the two back), and of
each prefix there is one such segmentation.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .shared import local_file

BLOCK = 256  # characters in a block of the splitter
LONG_PIECE = 96  # bytes of a piece that run in lockstep; what is longer ends one by one
STATES_KEPT = 250_000  # compiled merger states a worker keeps before it starts afresh

# Splitter: character classes.
LETTER, NUMBER, OTHER, SPACE, WHITE, QUOTE, SHORT, R, E, V, L, END = range(12)
# Splitter: states. DONE: a contraction or nothing stands before. APOS*: inside a possible contraction.
DONE, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_SPACE, AFTER_WHITE, APOS, APOS_R, APOS_V, APOS_L = range(10)
HERE, BEFORE = 1, 2  # outputs: a piece starts at this character, at the one before


def splitter_tables() -> tuple[np.ndarray, np.ndarray]:
    """(next state, output) by state * 12 + class."""
    nxt, out = np.zeros((10, 12), np.uint8), np.zeros((10, 12), np.uint8)
    plain = {LETTER: IN_LETTERS, SHORT: IN_LETTERS, R: IN_LETTERS, E: IN_LETTERS, V: IN_LETTERS, L: IN_LETTERS,
             NUMBER: IN_NUMBERS, OTHER: IN_OTHER, SPACE: AFTER_SPACE, WHITE: AFTER_WHITE}
    for state in range(10):
        for c in range(12):
            if c == END:
                nxt[state, c], out[state, c] = DONE, 0
                if state in (APOS_R, APOS_V, APOS_L):
                    out[state, c] = BEFORE  # the quote stands alone, the letter after it too
                continue
            kind = plain.get(c, IN_OTHER)
            to, mark = kind, HERE
            if state in (IN_LETTERS, IN_NUMBERS, IN_OTHER) and kind == state:
                mark = 0
            elif state == AFTER_SPACE and kind in (IN_LETTERS, IN_NUMBERS, IN_OTHER):
                mark = BEFORE  # the last space goes with what follows
            elif state == AFTER_WHITE and kind in (IN_LETTERS, IN_NUMBERS, IN_OTHER):
                mark = HERE | BEFORE  # the last white space stands alone
            elif state in (AFTER_SPACE, AFTER_WHITE):
                mark = 0
            elif state == APOS:
                if c == SHORT:
                    to, mark = DONE, 0
                elif c in (R, V, L):
                    to, mark = {R: APOS_R, V: APOS_V, L: APOS_L}[c], 0
                elif kind == IN_OTHER:
                    to, mark = IN_OTHER, 0
            elif state in (APOS_R, APOS_V, APOS_L):
                if (state, c) in ((APOS_R, E), (APOS_V, E), (APOS_L, L)):
                    to, mark = DONE, 0
                else:
                    mark = BEFORE if kind == IN_LETTERS else HERE | BEFORE
            if c == QUOTE and to == IN_OTHER and mark & HERE:
                to = APOS  # a quote that starts a piece without a space in it
            nxt[state, c], out[state, c] = to, mark
    return nxt.ravel(), out.ravel()


_CLASSES: np.ndarray | None = None


def _as_the_library(table: np.ndarray) -> None:
    """Puts right which code points are letters and numbers: the library's tables and those of regex are of different Unicode versions.

    Runs of one class that the library's own splitter keeps in one piece with a sign of that class
    are as it has them; of all others every code point is asked for alone.  Beyond the third plane neither knows a letter.
    """
    from tokenizers.pre_tokenizers import ByteLevel

    def kept(before: str, texts: list[str]) -> np.ndarray:
        """Which of texts are one piece with before."""
        ends = np.cumsum([len(x) + 2 for x in texts])
        pieces = {place for _, place in ByteLevel(add_prefix_space=False).pre_tokenize_str("".join(f"{before}{x}\n" for x in texts))}
        return np.array([(end - len(x) - 2, end - 1) in pieces for x, end in zip(texts, ends.tolist(), strict=True)], bool)

    known = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x40000)])
    cuts = np.flatnonzero(np.diff(table[known])) + 1
    runs: dict[int, list[str]] = {LETTER: [], NUMBER: [], OTHER: []}
    for run in np.split(known, cuts):
        if table[run[0]] != WHITE:
            runs[table[run[0]]].append("".join(map(chr, run.tolist())))
    signs = {LETTER: "a", NUMBER: "1", OTHER: "!"}
    unlike = [c for kind, texts in runs.items() for x, same in zip(texts, kept(signs[kind], texts), strict=True) if not same for c in x]
    for kind in (LETTER, NUMBER, OTHER):
        table[[ord(c) for c, same in zip(unlike, kept(signs[kind], unlike), strict=True) if same]] = kind


def character_classes() -> np.ndarray:
    """Class of every code point; text ends are 0x110000."""
    global _CLASSES
    if _CLASSES is None:
        import regex

        table = np.full(0x110001, OTHER, np.uint8)
        everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", WHITE)):
            for m in regex.finditer(pattern, everything):
                a, b = ord(m[0][0]), ord(m[0][-1])
                if b - a + 1 == len(m[0]):
                    table[a : b + 1] = kind
                else:
                    table[[ord(x) for x in m[0]]] = kind
        _as_the_library(table)
        for text, kind in ((" ", SPACE), ("'", QUOTE), ("stmd", SHORT), ("r", R), ("e", E), ("v", V), ("l", L)):
            table[[ord(x) for x in text]] = kind
        table[0x110000] = END
        _CLASSES = table
    return _CLASSES


def compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """State maps of neighbours: entry state -> exit state after both."""
    return np.take_along_axis(then, first, axis=1)


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive scan of state maps: log2(blocks) rounds, each over all blocks at once."""
    scanned, step = maps.astype(np.intp), 1
    while step < len(scanned):
        scanned[step:] = compose(scanned[:-step].copy(), scanned[step:])
        step *= 2
    return scanned


_SPLIT = splitter_tables()


def piece_starts(points: np.ndarray) -> np.ndarray:
    """Positions in points (code points, 0x110000 after each text) where pieces start."""
    nxt, out = _SPLIT
    blocks = -(-len(points) // BLOCK)
    kinds = np.full(blocks * BLOCK, END, np.uint8)
    kinds[: len(points)] = character_classes()[points]
    columns = np.ascontiguousarray(kinds.reshape(blocks, BLOCK).T)
    maps = np.tile(np.arange(10, dtype=np.uint8), (blocks, 1))
    for column in columns:
        maps = nxt[maps * 12 + column[:, None]]
    state = np.zeros(blocks, np.uint8)
    state[1:] = prefix_scan(maps)[:-1, DONE]
    marks = np.empty((BLOCK, blocks), np.uint8)
    for i, column in enumerate(columns):
        at = state * 12 + column
        marks[i], state = out[at], nxt[at]
    marks = marks.T.ravel()
    starts = np.zeros(len(points) + 1, bool)
    starts[: len(points)] = marks[: len(points)] & HERE
    back = np.flatnonzero(marks[: len(points)] & BEFORE) - 1
    starts[back] = True
    return np.flatnonzero(starts)


class Merger:
    """Byte-pair merges as a transducer whose transitions carry changes of the token count."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        to_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        raw = lambda token: bytes(to_byte[c] for c in token)
        self.special = [t["content"] for t in spec["added_tokens"]]
        special = set(self.special)
        self.tokens = {raw(t): i for t, i in model["vocab"].items() if t not in special}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {i: -1 for i in self.tokens.values()}
        for n, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            ia, ib, ic = model["vocab"][a], model["vocab"][b], model["vocab"][a + b]
            self.rank[ia, ib] = n
            if ic not in self.parts:
                self.parts[ic], self.made[ic] = (ia, ib), n
        # Trie over the vocabulary; node 0 is the root.
        self.child: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for text, i in self.tokens.items():
            if len(text) > 1 and i not in self.parts:
                continue  # no merge makes it
            node = 0
            for b in text:
                if b not in self.child[node]:
                    self.child[node][b] = len(self.child)
                    self.child.append({})
                    self.token_at.append(-1)
                node = self.child[node][b]
            self.token_at[node] = i
        self.stable_pairs: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.columns = np.full(256, -1, np.int64)
        self.width = 16
        self.used = 0
        self.next = np.full((4096, self.width), -1, np.int32)
        self.emit = np.zeros((4096, self.width), np.int8)
        self.intern(((0, -1, 0),))

    def intern(self, state: tuple) -> int:
        if state not in self.ids:
            self.ids[state] = len(self.states)
            self.states.append(state)
            if len(self.states) > len(self.next):
                self.next = np.vstack([self.next, np.full_like(self.next, -1)])
                self.emit = np.vstack([self.emit, np.zeros_like(self.emit)])
        return self.ids[state]

    def column(self, byte: int) -> int:
        """The byte's column; bytes get columns in the order they turn up."""
        if self.columns[byte] < 0:
            if self.used == self.width:
                self.next = np.hstack([self.next, np.full_like(self.next, -1)])
                self.emit = np.hstack([self.emit, np.zeros_like(self.emit)])
                self.width *= 2
            self.columns[byte] = self.used
            self.used += 1
        return int(self.columns[byte])

    def stable(self, left: int, right: int) -> bool:
        """Whether merging left + right gives the two back.

        Undoes merges on both sides of the seam, the latest first, and looks at each pair of
        neighbours that ever met there: it joins if its rank comes before the merge that
        takes one of the two away (for the left one also not at the same rank, as merges of
        one rank run from left to right).
        """
        key = (left, right)
        known = self.stable_pairs.get(key)
        if known is None:
            a, b, gone_a, gone_b, known = left, right, 1 << 60, 1 << 60, True
            while True:
                r = self.rank.get((a, b))
                if r is not None and r < gone_a and r <= gone_b:
                    known = False
                    break
                if self.made[a] > self.made[b]:
                    gone_a, a = self.made[a], self.parts[a][1]
                elif self.made[b] >= 0:
                    gone_b, b = self.made[b], self.parts[b][0]
                else:
                    break
            self.stable_pairs[key] = known
        return known

    def compile(self, state: int, byte: int) -> None:
        """Adds the transition of a state by a byte."""
        token, gain, alive = -1, 0, []
        for node, last, count in self.states[state]:  # longest suffix first
            to = self.child[node].get(byte)
            if to is None:
                continue
            if token < 0 and (t := self.token_at[to]) >= 0 and (last < 0 or self.stable(last, t)):
                token, gain = t, count + 1
            if self.child[to]:
                alive.append((to, last, count))
        column = self.column(byte)
        after = self.intern((*((n, last, c - gain) for n, last, c in alive), (0, token, 0)))
        self.next[state, column], self.emit[state, column] = after, gain

    def counts(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of each piece data[start : start + length]."""
        if len(self.states) > STATES_KEPT:
            self.reset()
            self.stable_pairs.clear()
        for b in np.flatnonzero(np.bincount(data, minlength=256)):
            self.column(int(b))
        symbols = self.columns[data]
        order = np.argsort(-lengths, kind="stable")
        starts, sizes = starts[order], lengths[order]
        totals, state = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        depth = int(sizes[0]) if len(sizes) else 0
        left = np.searchsorted(-sizes, -np.arange(min(depth, LONG_PIECE)), side="left")  # pieces longer than i
        for i in range(min(depth, LONG_PIECE)):
            n = left[i]
            now, by = state[:n], symbols[starts[:n] + i]
            to = self.next[now, by]
            if (new := np.flatnonzero(to < 0)).size:
                for key in np.unique(now[new] * 256 + data[starts[new] + i]):
                    self.compile(int(key) >> 8, int(key) & 255)
                to = self.next[now, by]
            totals[:n] += self.emit[now, by]
            state[:n] = to
        for k in np.flatnonzero(sizes > LONG_PIECE):
            now, total = int(state[k]), 0
            for b in data[starts[k] + LONG_PIECE : starts[k] + sizes[k]].tolist():
                if len(self.states) > STATES_KEPT:  # a piece of any length goes on from its state in an empty table
                    here = self.states[now]
                    self.reset()
                    self.stable_pairs.clear()
                    now = self.intern(here)
                column = self.column(b)
                if self.next[now, column] < 0:
                    self.compile(now, b)
                total += int(self.emit[now, column])
                now = int(self.next[now, column])
            totals[k] += total
        result = np.empty_like(totals)
        result[order] = totals
        return result


_MERGERS: dict[str, Merger] = {}


def count_tokens(texts: list[str], tokenizer: str) -> np.ndarray:
    """Tokens of each text, as the tokenizer's own library counts them by default."""
    merger = _MERGERS.get(tokenizer) or _MERGERS.setdefault(tokenizer, Merger(local_file(tokenizer)))
    totals = np.zeros(len(texts), np.int64)
    segments, owners = [], []
    for k, text in enumerate(texts):
        pieces = [text]
        for special in merger.special:
            if special in text:
                pieces = [x for p in pieces for x in p.split(special)]
        totals[k] += len(pieces) - 1  # each special string inside a text is a token
        for p in pieces:
            if p:
                segments.append(p)
                owners.append(k)
    if not segments:
        return totals
    joined = "".join(segments)
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    ends = np.cumsum(sizes)
    flat = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.full(len(flat) + len(segments), 0x110000, np.uint32)
    keep = np.ones(len(points), bool)
    keep[ends + np.arange(len(segments))] = False
    points[keep] = flat
    starts = piece_starts(points)
    starts = starts[keep[starts]]
    text_of = np.searchsorted(ends + np.arange(len(segments)), starts)
    width = 1 + (flat > 0x7F).astype(np.int64) + (flat > 0x7FF) + (flat > 0xFFFF)
    byte_at = np.concatenate([[0], np.cumsum(width)])
    first = byte_at[starts - text_of]
    length = np.diff(np.append(first, byte_at[-1]))
    data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
    counted = merger.counts(data, first, length)
    np.add.at(totals, np.asarray(owners)[text_of], counted)
    return totals


def token_counts(df: DataFrame, tokenizer: str, text: str = "text", out: str = "n_tokens", block_chars: int = 2_000_000) -> DataFrame:
    """df with the number of tokens of every whole text in column out.

    A null text counts as the empty text and has no tokens.  Rows are never moved: each
    Arrow batch is cut into blocks of about block_chars characters, which bound the memory
    of the lockstep runs.  A column of df with the name out, in any case, is replaced.
    """

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts, found, at = batch.fillna("").tolist(), [], 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (end == at or chars + len(texts[end]) <= block_chars):
                    chars += len(texts[end])
                    end += 1
                found.append(count_tokens(texts[at:end], tokenizer))
                at = end
            yield pd.Series(np.concatenate(found) if found else np.zeros(0, np.int64))

    return df.withColumn(out, counted(F.col(text).cast("string")))
