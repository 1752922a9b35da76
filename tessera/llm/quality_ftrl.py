"""Quality scores by a hashed word n-gram logistic regression (operator 7).

Trained by follow-the-regularised-leader with per-coordinate rates and an L1 term, so most
weights stay zero; scored as a sparse dot product of a text's n-gram counts and the weights.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

BITS = 18  # weights: 2 ** BITS
WORDS_KEPT = 400_000
WORD_KEPT = 64  # characters of a word that is remembered; longer ones are read anew each time
MULTIPLIER = np.uint32(0x9E3779B1)  # spreads the products of neighbouring words' hashes


# --- learner ----------------------------------------------------------------------------


class Ftrl:
    """Follow-the-regularised-leader, proximal form, for logistic loss on sparse rows."""

    def __init__(self, size: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.3, l2: float = 1.0):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        """One row: distinct positions, their values, the label."""
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def train(rows: list[tuple[np.ndarray, np.ndarray, float]], size: int, epochs: int, seed: int = 0, **rates: float) -> np.ndarray:
    """Weights after epochs passes in a fixed random order; zeros (score 0.5) without rows."""
    model, order = Ftrl(size, **rates), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            model.learn(*rows[i])
    return model.weights().astype(np.float32)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, key: str, keep, most_rows: int) -> DataFrame:
    """(key, text, y) of at most most_rows labelled documents for which keep holds: those with the smallest hash of the key.

    The choice is made on the narrow label table; what is broadcast has most_rows rows at most.
    """
    chosen = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & keep).select(key, F.col(label).cast("int").alias("y")).groupBy(key).agg(F.max("y").alias("y"))
    chosen = chosen.orderBy(F.xxhash64(key), key).limit(most_rows)
    return docs.join(F.broadcast(chosen), key).select(key, "text", "y")


# --- features ---------------------------------------------------------------------------

_CUT = re.compile(r"\d+|[^\W\d_]+|[\W_]+")


class Words(dict):
    """Word -> (hash of its letters, hash of its shape), both 32 bits, packed into one integer."""

    def __missing__(self, word: str) -> int:
        if len(self) > WORDS_KEPT:
            self.clear()
        core = word.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
        shape = []
        for part in _CUT.findall(word):
            if part[0].isdigit():
                shape.append("9")
            elif part[0].isalpha():
                shape.append("X" if part.isupper() and len(part) > 1 else "Xx" if part[0].isupper() else "x")
            else:
                shape.append(part)
        packed = zlib.crc32(core.lower().encode("utf-8", "surrogatepass")) << 32 | zlib.crc32("".join(shape).encode("utf-8", "surrogatepass"))
        if len(word) <= WORD_KEPT:
            self[word] = packed
        return packed


_WORDS = Words()


def features(text: str) -> np.ndarray:
    """Hashed positions, with repeats, of the words, word pairs, shapes, shape pairs and echoes of a whole text.

    An echo is a word that equals the one before, or the one two before.  Position 0 is the
    bias alone; what would hash to it is at 1.
    """
    words = text.split()
    if not words:
        return np.zeros(1, np.int64)
    packed = np.array([_WORDS[w] for w in words], np.uint64)
    core, shape = (packed >> np.uint64(32)).astype(np.uint32), packed.astype(np.uint32)
    pair = core[:-1] * MULTIPLIER ^ core[1:]
    shapes = shape[:-1] * MULTIPLIER ^ shape[1:] ^ np.uint32(0x5BD1E995)
    echo = np.concatenate([np.where(core[1:] == core[:-1], np.uint32(11), np.uint32(12)), np.where(core[2:] == core[:-2], np.uint32(13), np.uint32(14))])
    mixed = np.concatenate([core, pair, shape ^ np.uint32(0xA5A5A5A5), shapes, echo]) * MULTIPLIER
    return np.append(np.maximum((mixed >> np.uint32(32 - BITS)).astype(np.int64), 1), 0)


def sparse_row(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct positions and their values: counts over the square root of the number of words, and 1 for the bias."""
    at, counts = np.unique(features(text), return_counts=True)
    x = counts / np.sqrt(max(1, counts.sum() / 5))
    x[0] = 1.0  # the bias, which every text has
    return at, x


def score_text(text: str, weights: np.ndarray) -> float:
    at = features(text)
    words = max(1.0, len(at) / 5)
    dot = float(weights[at[:-1]].sum(dtype=np.float64)) / np.sqrt(words) + float(weights[0])
    return 1 / (1 + np.exp(-np.clip(dot, -35, 35)))


# --- Spark ------------------------------------------------------------------------------


def fit_quality(sample: DataFrame, epochs: int = 3, text: str = "text", label: str = "y") -> np.ndarray:
    """Weights from a bounded labelled sample: rows become sparse rows where they are, one task runs the learner over them.

    Without rows all weights are zero and every text scores 0.5: nothing is known against any.

    sample is bounded by the caller (see labelled_sample); it is put in the order of its
    hashed text, so the weights don't depend on how it was partitioned.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [sparse_row(t or "") for t in batch["text"]]
            yield pd.DataFrame({"o": [zlib.crc32((t or "").encode("utf-8", "surrogatepass")) for t in batch["text"]], "at": [m[0].astype("<i4").tobytes() for m in made], "x": [m[1].astype("<f4").tobytes() for m in made], "y": batch["y"].astype("float64")})

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = [(np.frombuffer(a, "<i4"), np.frombuffer(x, "<f4").astype(np.float64), y) for b in batches for a, x, y in zip(b["at"], b["x"], b["y"], strict=True)]
        yield pd.DataFrame({"w": [train(read, 1 << BITS, epochs).tobytes()]})

    sparse = sample.select(F.col(text).alias("text"), F.col(label).alias("y")).mapInPandas(rows, "o long, at binary, x binary, y double")
    learned = sparse.repartition(1).sortWithinPartitions("o", "y").mapInPandas(learn, "w binary").collect()
    return np.frombuffer(b"".join(bytes(r.w) for r in learned), np.float32) if learned else np.zeros(1 << BITS, np.float32)


def quality_scores(df: DataFrame, weights: np.ndarray, text: str = "text", out: str = "score") -> DataFrame:
    """df with the score of every whole text (0 to 1; null texts count as empty and score the bias alone).

    A column of df with the name out, in any case, is replaced.
    """
    sent = df.sparkSession.sparkContext.broadcast(weights)  # 2 ** BITS numbers

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        w = sent.value
        return pd.Series([score_text(t or "", w) for t in texts], dtype="float64")

    return df.withColumn(out, scores(F.col(text).cast("string")))
