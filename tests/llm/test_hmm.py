import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import hmm_lm as H, queries

SF01 = "/root/testdata/sf0.01"


def small_model(states=3, symbols=5, seed=0):
    rng = np.random.default_rng(seed)
    part = lambda *shape: (x := rng.random(shape)) / x.sum(axis=-1, keepdims=True)
    return H.Model(part(states), part(states, states), part(states, symbols).T.copy())


def all_paths(sequence, model, first):
    """{path: probability} by brute force."""
    out = {}
    for path in itertools.product(range(len(first)), repeat=len(sequence)):
        p = first[path[0]] * model.signs[sequence[0], path[0]]
        for t in range(1, len(path)):
            p *= model.moves[path[t - 1], path[t]] * model.signs[sequence[t], path[t]]
        out[path] = p
    return out


@pytest.mark.parametrize("stretch", [None, 1, 2, 3])
def test_forward_and_expected_counts_against_all_paths(stretch):
    """Probabilities and counts of whole texts, whatever the stretches."""
    model = small_model()
    sequences = [np.array(s) for s in ([1], [0, 2, 4, 4], [3, 3], [4, 0, 1, 2, 3, 3, 1])]
    scores = H.forward_scores(sequences, model, stretch)
    found, want = H.Expected(5, 3), H.Expected(5, 3)
    found.add(sequences, model, stretch)
    for s, score in zip(sequences, scores, strict=True):
        paths = all_paths(s, model, model.first)
        total = sum(paths.values())
        assert math.exp(score) == pytest.approx(total)
        want.log += math.log(total)
        for path, p in paths.items():
            want.first[path[0]] += p / total
            for t, k in enumerate(path):
                want.signs[s[t], k] += p / total
                if t:
                    want.moves[path[t - 1], k] += p / total
    assert np.allclose(found.signs, want.signs) and np.allclose(found.moves * model.moves, want.moves)
    assert np.allclose(found.first, want.first) and found.log == pytest.approx(want.log)


def test_a_texts_borders_change_its_counts():
    """A text's counts are not those of its halves: nothing is cut in training."""
    model, text = small_model(), np.random.default_rng(3).integers(0, 5, 400)
    whole, halves = H.Expected(5, 3), H.Expected(5, 3)
    whole.add([text], model)
    halves.add([text[:200], text[200:]], model)
    assert (whole.moves * model.moves).sum() == pytest.approx(399) and (halves.moves * model.moves).sum() == pytest.approx(398)


def test_long_texts_in_stretches(monkeypatch):
    model, rng = small_model(8, 50), np.random.default_rng(5)
    texts = [rng.integers(0, 50, n) for n in (1, 7, 3000, 40, 999, 1000)]
    plain = H.Expected(50, 8)
    plain.add(texts, model, 10_000)
    monkeypatch.setattr(H, "SYMBOLS_AT_ONCE", 700)
    for stretch in (64, 100, 333):
        found = H.Expected(50, 8)
        found.add(texts, model, stretch)
        assert np.allclose(H.forward_scores(texts, model, stretch), H.forward_scores(texts, model, 10_000), rtol=1e-12)
        assert all(np.allclose(getattr(found, x), getattr(plain, x), rtol=1e-9) for x in ("first", "moves", "signs", "log"))


def test_borders_without_matrices(monkeypatch):
    """Up to LEVELS stretches a text's borders cost no matrix a symbol, and are those that matrices give."""
    model, rng = small_model(8, 50), np.random.default_rng(6)
    texts = [rng.integers(0, 50, n) for n in (1, 100, 101, 250, 16 * 100, 700)]
    monkeypatch.setattr(H, "LEVELS", 1)
    by_matrices, scores = H.Stretches(texts, model, 100), H.forward_scores(texts, model, 100)
    monkeypatch.undo()
    monkeypatch.setattr(H, "transfers", lambda *_: pytest.fail("matrices of a short text"))
    found = H.Stretches(texts, model, 100)
    H.Expected(50, 8).add(texts, model, 100)
    assert np.allclose(H.forward_scores(texts, model), scores, rtol=1e-12)
    assert np.array_equal(found.first, by_matrices.first)
    for x in ("entry", "before", "back"):
        got, want = getattr(found, x), getattr(by_matrices, x)
        scaled = lambda v: v / np.maximum(v.sum(axis=1, keepdims=True), 1e-300)
        assert np.allclose(scaled(got), scaled(want), rtol=1e-10)


def test_rare_symbols_do_not_underflow():
    """Eight steps of symbols as improbable as those of a very large corpus."""
    model = small_model(4, 6)
    model.signs[5] = 1e-30
    found = H.Expected(6, 4)
    found.add([np.full(1000, 5), np.array([5] * 9 + [1])], model, 64)
    assert np.isfinite(found.signs).all() and found.signs.sum() == pytest.approx(1010) and (found.moves * model.moves).sum() == pytest.approx(999 + 9)


def test_words_of_many_texts():
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("aBZ \t\n\x0b\x0c\r\x1c\x85\xa0é İ\0"), rng.integers(0, 20))) for _ in range(500)]
    texts += [None, "", "  ", "x" * 64 + " Y", "X" * 65, "É" * 33 + "\n"]
    found = []
    for some in H.pieces(pa.array(texts), 100):
        words, owner = H.words_in(pa.array(texts)[some])
        lists = [[] for _ in range(some.stop - some.start)]
        for w, i in zip(words.to_pylist(), owner, strict=True):
            lists[i].append(w)
        found += lists
    assert found == [H.words_of(t) for t in texts]
    assert list(H.pieces(pa.array([], pa.string()), 100)) == []


def test_query_counts_and_base(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()]
    rows = {r.doc_id: r for r in queries.op4_hmm_scores(spark, SF01).collect()}
    assert len(rows) == len(docs)
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in docs}
    counts = Counter()
    for k, t in docs:
        if not held[k]:
            counts.update(t.encode().lower().split())
            counts[b""] += 1
    n, v = sum(counts.values()), len(counts)
    better = 0
    for k, t in docs:
        r, tokens = rows[k], [*t.encode().lower().split(), b""]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[k], len(tokens), n)
        assert r.n_known == sum(counts[w] > 0 for w in tokens)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens), rel=1e-9)
        better += held[k] and r.score > r.base_score
    assert better > 0.8 * sum(held.values())


def test_small_head_gives_the_same_counts(spark, monkeypatch):
    texts = ["a b c", "a a b", "b d", None, "", "c c c a"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    none = F.lit(False)
    whole = {r.doc_id: r for r in H.hmm_scores(df, none, rounds=2).collect()}
    monkeypatch.setattr(H, "HEAD", 2)
    monkeypatch.setattr(H, "OWN", 1)
    small = {r.doc_id: r for r in H.hmm_scores(df, none, rounds=2).collect()}
    for k, r in whole.items():
        assert small[k].base_score == pytest.approx(r.base_score) and small[k].n_known == r.n_known == r.n_tokens


@pytest.mark.parametrize("head", [0, 1, 3, 5, 6, 40, 100])
def test_head_is_full_whatever_the_ties(spark, monkeypatch, head):
    monkeypatch.setattr(H, "HEAD", head)
    rows = [(b"w%d" % i, 7 if i < 4 else 6 if i < 6 else 5) for i in range(50)]
    found = H.head_of(spark.createDataFrame(rows, "word binary, n long"))
    assert len(found) == len(set(found)) == min(head, 50) and set(found) <= set(rows)
    assert sorted((n for _, n in found), reverse=True) == sorted((n for _, n in rows), reverse=True)[:head]
    assert H.head_of(spark.createDataFrame([], "word binary, n long")) == []


def plain_score(tokens, vocab, counts, model):
    """log10 probability of a text by all paths of states; a word of a class has its share of the class."""
    symbols, shares = [], 0.0
    for w in tokens:
        place = vocab.head.get(w)
        if place is not None and vocab.symbols[place] < vocab.own:
            symbols.append(int(vocab.symbols[place]))
            continue
        k = H.class_of(w)
        symbols.append(vocab.own + k)
        own = {x for x, i in vocab.head.items() if vocab.symbols[i] < vocab.own}
        inside = {x: n for x, n in counts.items() if x not in own and H.class_of(x) == k}
        shares += math.log10((counts.get(w, 0) + 1) / (sum(inside.values()) + len(inside) + 1))
    return math.log10(sum(all_paths(np.array(symbols), model, model.first).values())) + shares


def test_scores_by_brute_force_and_their_sum(spark, monkeypatch):
    """score of known, rare, unknown and long words; and the probabilities of all words, first and after a first one, are one."""
    monkeypatch.setattr(H, "HEAD", 3)
    monkeypatch.setattr(H, "OWN", 2)
    train = ["a b c a", "a b long" + "g" * 80, "b a d e", "c a"]
    words = ["a", "b", "c", "d", "e", "long" + "g" * 80]
    unknown = {}
    for i in range(20_000):
        unknown.setdefault(H.class_of(w := b"%xu%x" % (i, i * 37 % 65536)), w)
    assert len(unknown) == H.CLASSES
    asked = [f"{x} {y}" for x in words for y in words] + ["", "a", "a b u1 c", "u1 u2"]
    df = spark.createDataFrame([(str(i), t, i < 4) for i, t in enumerate([*train, *asked])], "doc_id string, text string, learn boolean")
    rows = {int(r.doc_id): r for r in H.hmm_scores(df, ~F.col("learn"), rounds=3, states=2).collect()}
    counts = Counter(w for t in train for w in [*H.words_of(t), H.END])
    learned = spark.createDataFrame([(t,) for t in train], "text string")
    vocab = H.vocabulary(H.word_counts(learned))
    model, _ = H.trained(H.encoded(learned.select("text", F.lit("").alias("key"), F.lit(False).alias("held_out")), vocab), vocab, 3, 2)
    for i, t in enumerate([*train, *asked]):
        assert rows[i].score == pytest.approx(plain_score([*H.words_of(t), H.END], vocab, counts, model), abs=1e-6)
    every = [*(H.words_of(w)[0] for w in words), H.END, *unknown.values()]
    assert sum(10 ** plain_score([w], vocab, counts, model) for w in every) == pytest.approx(1.0)
    assert sum(10 ** plain_score([b"a", w], vocab, counts, model) for w in every) == pytest.approx(10 ** plain_score([b"a"], vocab, counts, model))


def test_training_raises_the_likelihood(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").limit(300)
    rows = docs.select("text", F.col("doc_id").alias("key"), F.lit(False).alias("held_out"))
    counts = H.word_counts(rows.select("text"))
    vocab = H.vocabulary(counts)
    _, logs = H.trained(H.encoded(rows, vocab), vocab, rounds=4)
    assert logs == sorted(logs)


def test_hard_tables(spark):
    df = spark.createDataFrame([(None, "x y", 1), (1, "x " * 5000, 2), (1, "x " * 5000, 2), (2, "w" * 30_000, 3), (3, None, 4)], "doc_id long, text string, score int")
    rows = H.hmm_scores(df, F.lit(True), rounds=1).collect()
    assert len(rows) == 5 and all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and math.isfinite(r.score) for r in rows)
    assert H.hmm_scores(df.limit(0), F.lit(False), rounds=1).count() == 0
    rows = H.hmm_scores(df, F.col("doc_id") == 3, rounds=1).collect()
    assert {(r.doc_id, r.n_tokens) for r in rows} == {(None, 3), (1, 5001), (2, 2), (3, 1)}
