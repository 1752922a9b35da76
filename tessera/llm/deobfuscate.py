"""Toxicity scores of texts restored by a noisy-channel decoder (operator 5).

Disguised writing (digits and signs for letters, letters spaced out, letters repeated) is a
lattice: every position offers the letters that the sign may stand for, a run may have been
one letter or two, a separator between single letters may be nothing or a word end.  The
Viterbi path under a character trigram model, trained on the whole corpus, and the channel's
costs is the restored text.  A word with one path only is its own restoration.

The restored words and the words' beginnings are the features of a sparse logistic
regression; a text has a feature or hasn't, so a long text can't dilute an insult.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .quality_ftrl import Ftrl
from .shared import Sent, batches_of, kept_by

BITS = 20
WORDS_KEPT = 150_000
COUNTED_AT_ONCE = 250_000  # characters, some 40 bytes each while they are counted
AT_ONCE = 500  # texts of a batch that are counted
WORD_KEPT = 64  # characters of a token that is remembered
UNLABELLED = -4.0  # the bias where nothing is labelled: a text scores 0.018, as nothing is known to be toxic

# Which letters a sign may stand for, and the separators of spaced-out words.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "tl", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "(": "c", "¡": "i", "£": "l"}
SEPARATORS = " .-_~/"
HIDDEN = "*#"  # a letter crossed out, most often a vowel, or a separator
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
VOWELS = "aeiou"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»“”‘’…"

SYMBOLS = " abcdefghijklmnopqrstuvwxyzßàáâäçèéêëíîïñóôöùúûü"
OTHER = len(SYMBOLS)
N = OTHER + 1
_SYMBOL = {c: i for i, c in enumerate(SYMBOLS)}
_POINTS = np.full(0x110000, OTHER, np.uint8)
for _c, _i in _SYMBOL.items():
    _POINTS[ord(_c)] = _i
_POINTS[[9, 10, 11, 12, 13]] = 0
for _c in PUNCTUATION:
    _POINTS[ord(_c)] = 0

SUBSTITUTED, KEPT_SIGN, DROPPED, SHORTENED, SPLIT, GUESSED = -1.0, -6.0, -3.0, -0.5, -2.0, -1.0  # the channel, in log10 and by judgement


# --- character model --------------------------------------------------------------------


def count_trigrams(df: DataFrame, text: str = "text") -> DataFrame:
    """(trigram, n) over all whole lower-cased texts; at most N ** 3 rows. Every text is read with a space before and after."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("deobfuscate")
        total = np.zeros(N**3, np.int64)
        for batch in batches:
            texts, held = [], 0
            values = batch.column(0).to_pylist()
            for i, t in enumerate(values):
                texts.append(t or "")
                held += len(texts[-1])
                if held > COUNTED_AT_ONCE or i + 1 == len(values):
                    raw = ("  " + "  ".join(texts) + "  ").lower().encode("utf-32-le", "surrogatepass")
                    s = _POINTS[np.frombuffer(raw, np.uint32)].astype(np.int64)
                    total += np.bincount((s[:-2] * N + s[1:-1]) * N + s[2:], minlength=N**3)
                    texts, held = [], 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"trigram": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    counted = df.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "trigram long, n long")
    return counted.groupBy("trigram").agg(F.sum("n").alias("n"))


def character_model(df: DataFrame, text: str = "text") -> np.ndarray:
    """log10 P(c | a, b), indexed [a, b, c]: trigrams smoothed by bigrams, those by single characters."""
    counts = np.zeros(N**3)
    with batches_of(df.sparkSession, AT_ONCE):
        found = count_trigrams(df, text).collect()  # N ** 3 rows at most
    for r in found:
        counts[r.trigram] = r.n
    three = counts.reshape(N, N, N)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + N)
    p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
    p3 = (three + 5 * p2[None]) / (three.sum(axis=2, keepdims=True) + 5)
    return np.log10(p3).astype(np.float32)


# --- decoder ----------------------------------------------------------------------------


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """What each run of equal characters of a lower-cased token may stand for, with the channel's cost."""
    steps, at = [], 0
    while at < len(token):
        c, end = token[at], at + 1
        while end < len(token) and token[end] == c:
            end += 1
        run, last = end - at, end == len(token)
        if c in SEPARATORS:
            options = [("", SHORTENED), (" ", SPLIT)]
        elif c in INVISIBLE:
            options = [("", 0.0)]
        elif c in HIDDEN:
            inside = at > 0 and not last
            options = [("", SHORTENED), (" ", SPLIT)] + [(v, GUESSED) for v in VOWELS if inside and run == 1]
        elif c in LEET:
            options = [(x, SUBSTITUTED) for x in LEET[c]] + [(x * 2, SUBSTITUTED + SHORTENED) for x in LEET[c] if run > 1]
            options += [(c * run, KEPT_SIGN)] if c.isdigit() else [("", DROPPED if last or at == 0 else KEPT_SIGN)]
        elif c.isalpha():
            options = [(c * run, 0.0)] if run < 3 else [(c, SHORTENED), (c * 2, SHORTENED)]
        else:
            options = [("", DROPPED)]
        steps.append(options)
        at = end
    return steps


def viterbi(steps: list[list[tuple[str, float]]], model: np.ndarray) -> str:
    """The best reading of a lattice as a word, between two word ends.

    A state is the last two letters.  Each step notes, for every state, the state before and
    the letters of its best way there; the reading is put together once, from the end.
    """
    best: dict[tuple[int, int], float] = {(0, 0): 0.0}
    ways: list[dict[tuple[int, int], tuple[tuple[int, int], str]]] = []
    at, symbol = model.item, _SYMBOL.get
    for options in [*steps, [(" ", 0.0)]]:
        if len(best) == len(options) == 1:  # one way on: its cost moves no choice
            (state,), letters = best, options[0][0]
            to = (*state, *(symbol(c, OTHER) for c in letters[-2:]))[-2:]
            best = {to: 0.0}
            ways.append({to: (state, letters)})
            continue
        now: dict[tuple[int, int], float] = {}
        way: dict[tuple[int, int], tuple[tuple[int, int], str]] = {}
        for state, score in best.items():
            for letters, cost in options:
                (x, y), total = state, score + cost
                for c in letters:
                    k = symbol(c, OTHER)
                    # Each letter costs about one; without this reward the empty reading would always win.
                    total += at(x, y, k) + 1.0
                    x, y = y, k
                to = (x, y)
                if to not in now or now[to] < total:
                    now[to] = total
                    way[to] = (state, letters)
        best = now
        ways.append(way)
    state, read = max(best, key=lambda s: (best[s], s)), []
    for way in reversed(ways):
        state, letters = way[state]
        read.append(letters)
    return "".join(reversed(read)).strip()


_LETTER = re.compile(r"[^\W\d_]")
_SIGN = re.compile(rf"[0-9@$!|+€(¡£{INVISIBLE}]")
_CROSSED = re.compile(rf"[^\W\d_][{HIDDEN}]+[^\W\d_]|([^\W\d_])\1\1")


def disguised(token: str) -> bool:
    """Whether a token has a letter and a sign that may stand for one, a crossed-out letter or one written three times; one scan each."""
    return bool(_SIGN.search(token) and _LETTER.search(token) or _CROSSED.search(token))


_SPACED = re.compile(r"(?<![^\s])[^\s](?:[ .\-_*~/][^\s.\-_*~/]){2,}(?![^\s.,;:!?])")
_ONE_SIGN = re.compile(r"[^\w\s]")
_CLOSING = ".,;:!?'\")]}…»"
_RUNS = re.compile(r"(.)\1+", re.DOTALL)


def without_tail(token: str) -> str:
    """A token without its closing signs, or without the three or more equal signs that it ends in, whichever takes more."""
    end, last = len(token.rstrip(_CLOSING)), token[-1:]
    if _ONE_SIGN.match(last):
        before = len(token.rstrip(last))
        if len(token) - before >= 3:
            end = min(end, before)
    return token[:end]


def restore_token(token: str, model: np.ndarray) -> str:
    """The restored reading of one lower-cased token; words inside it are separated by spaces."""
    token = without_tail(token)
    if disguised(token):
        return viterbi(lattice(token), model)
    return token.strip(PUNCTUATION)


def spaced_runs(text: str) -> list[str]:
    """Stretches of single characters between single separators."""
    return [m[0] for m in _SPACED.finditer(text) if any(map(str.isalpha, m[0]))]


def restored_text(text: str, model: np.ndarray) -> str:
    """The whole lower-cased text with every disguised word and spaced-out stretch decoded."""
    lowered = text.lower()
    lowered = _SPACED.sub(lambda m: viterbi(lattice(m[0]), model) if any(map(str.isalpha, m[0])) else m[0], lowered)
    return " ".join(restore_token(t, model) for t in lowered.split())


# --- features and scores ----------------------------------------------------------------


def hashed(kind: str, word: str) -> int:
    return max(1, zlib.crc32(f"{kind}{word}".encode("utf-8", "surrogatepass")) >> (32 - BITS))  # 0 is the bias alone


def word_features(word: str) -> tuple[int, int, int]:
    """Positions of a restored word and of its beginnings; doubled letters count once."""
    plain = _RUNS.sub(r"\1", word)
    return hashed("w", plain), hashed("p", plain[:5]), hashed("q", plain[:4])


class Restorer(dict):
    """Token -> positions of its restored words."""

    def __init__(self, model: np.ndarray):
        self.model = model

    def __missing__(self, token: str) -> tuple[int, ...]:
        found = tuple(x for w in restore_token(token, self.model).split() or [""] for x in word_features(w))
        if len(token) <= WORD_KEPT:
            self[token] = found
        return found

    def positions(self, text: str) -> np.ndarray:
        """Distinct positions of a whole text; position 0 is the bias."""
        if len(self) > WORDS_KEPT:
            self.clear()
        lowered = text.lower()
        found = {0}
        found.update(*map(self.__getitem__, set(lowered.split())))
        for run in spaced_runs(lowered):
            # A neighbour of one letter may not belong to the spaced-out word: it is read with and without its ends.
            for part in (run, run[2:], run[:-2], run[2:-2]):
                if len(part) > 4:
                    for word in viterbi(lattice(part), self.model).split():
                        found.update(word_features(word))
        return np.fromiter(found, np.int64, len(found))


def restorer(sent: Sent) -> Restorer:
    """This worker's restorer for a model; one model is kept at a time."""
    kept = kept_by("deobfuscate")
    if sent.id not in kept:
        kept.clear()
        kept[sent.id] = Restorer(sent.value)
    return kept[sent.id]


def fit_toxicity(sample: DataFrame, model: np.ndarray, epochs: int = 8, text: str = "text", label: str = "y") -> np.ndarray:
    """Weights from a bounded labelled sample: texts become positions where they are, one task learns from those.

    Without any labelled row the bias alone has a weight, UNLABELLED, so that no text is called toxic.
    """
    sent = Sent(sample.sparkSession, model)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [restorer(sent).positions(t or "").astype("<i4") for t in batch["text"]]
            made = [np.sort(m) for m in made]
            yield pd.DataFrame({"o": [zlib.crc32(m.tobytes()) for m in made], "at": [m.tobytes() for m in made], "y": batch["y"].astype("float64")})

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = [(np.frombuffer(a, "<i4"), y) for b in batches for a, y in zip(b["at"], b["y"], strict=True)]
        learner, order = Ftrl(1 << BITS, alpha=2.0, l1=5.0, l2=0.5), np.random.default_rng(0)
        for _ in range(epochs):
            for i in order.permutation(len(read)):
                at, y = read[i]
                learner.learn(at, np.ones(len(at)), y)
        w = learner.weights().astype("<f4")
        at = np.union1d(np.flatnonzero(w), [0])
        yield pd.DataFrame({"at": at, "w": w[at]})

    sparse = sample.select(F.col(text).alias("text"), F.col(label).alias("y")).mapInPandas(rows, "o long, at binary, y double")
    weights = np.zeros(1 << BITS, np.float32)
    learned = sparse.repartition(1).sortWithinPartitions("o", "y").mapInPandas(learn, "at long, w float").collect()  # 2 ** BITS rows at most
    for r in learned:
        weights[r.at] = r.w
    if not learned:  # no row, so no task
        weights[0] = UNLABELLED
    return weights


def toxicity_scores(df: DataFrame, model: np.ndarray, weights: np.ndarray, text: str = "text", out: str = "score") -> DataFrame:
    """df with the score of every whole restored text: 0 to 1; null texts count as empty and score the bias alone.

    A column of df with the name out, in any case, is replaced.
    """
    spark = df.sparkSession
    sent, learned = Sent(spark, model), spark.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        w, by = learned.value, restorer(sent)
        dots = np.array([w[by.positions(t or "")].sum(dtype=np.float64) for t in texts], np.float64)
        return pd.Series(1 / (1 + np.exp(-np.clip(dots, -35, 35))))

    return df.withColumn(out, scores(F.col(text).cast("string")))


def restored(df: DataFrame, model: np.ndarray, text: str = "text", out: str = "restored") -> DataFrame:
    """df with every whole text as the decoder reads it (null stays null)."""
    sent = Sent(df.sparkSession, model)

    @F.pandas_udf("string")
    def read(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else restored_text(t, sent.value) for t in texts], dtype=object)

    return df.withColumn(out, read(F.col(text).cast("string")))


def held_out(key: str, modulus: int, remainder: int) -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % modulus == remainder
