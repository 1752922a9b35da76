import random

import numpy as np
from hypothesis import given, settings, strategies as st

from tessera.llm import decontaminate as C

SF01 = "/root/testdata/sf0.01"


def edit_rows(pattern, text):
    """Fewest edits of pattern against any stretch of text that ends at each place."""
    letters, steps = np.array([ord(c) for c in pattern]), np.arange(len(pattern) + 1)
    row = steps
    ends = [len(pattern)]
    for c in text:
        near = np.minimum(row[1:] + 1, row[:-1] + (letters != ord(c)))
        row = np.minimum.accumulate(np.concatenate([[0], near]) - steps) + steps  # skipping letters of the pattern costs one each
        ends.append(int(row[-1]))
    return ends


@settings(max_examples=300, deadline=None)
@given(st.text("ab c", min_size=1, max_size=12), st.text("ab c", max_size=40))
def test_myers_against_dynamic_programme(pattern, text):
    ends = edit_rows(pattern, text)
    assert C.best_end(pattern, text) == (min(ends), ends.index(min(ends)))


def edited(text, edits, rng):
    s = list(text)
    for _ in range(edits):
        i = rng.randrange(len(s))
        rng.choice([lambda: s.insert(i, "q"), lambda: s.pop(i), lambda: s.__setitem__(i, "z")])()
    return "".join(s)


def test_finds_all_within_budget(spark):
    rng = random.Random(5)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF01}/documents.parquet").limit(40).collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF01}/benchmark.parquet").limit(12).collect()]
    planted = []
    for n, (k, t) in enumerate(docs):
        item = items[n % len(items)]
        words = t.split()
        at = rng.randrange(len(words) + 1)
        passage = edited(item[1], rng.randrange(0, C.budget(len(item[1]), 0.08) + 4), rng).upper()
        planted.append((k, " ".join([*words[:at], passage, *words[at:]])))
    planted += [(None, items[0][1]), (10_001, None), (10_002, "")]
    df = spark.createDataFrame(planted, "doc_id long, text string")
    bench = spark.createDataFrame([*items, (99, None), (98, ""), (97, items[0][1])], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in C.contaminated(df, bench).collect()}
    want = {}
    for k, t in planted:
        plain = C.normalised(t)
        for i, x in [*items, (97, items[0][1])]:
            item = C.normalised(x)
            best = min(edit_rows(item, plain))
            if best <= C.budget(len(item), 0.08):
                want[k, i] = best
    assert {k: r.distance for k, r in got.items()} == want and len(want) > 20
    texts = dict(planted)
    for (k, i), r in got.items():
        item = C.normalised(dict([*items, (97, items[0][1])])[i])
        assert edit_rows(item, C.normalised(texts[k])[r.begin : r.end])[-1] <= r.distance + abs(r.end - r.begin - len(item))


def test_blocks_of_items_and_empty_tables(spark, monkeypatch):
    df = spark.createDataFrame([(1, "some words about nothing much", 0), (1, "some words about nothing much", 0)], "doc_id long, text string, distance int")
    bench = spark.createDataFrame([(i, "words about nothing" if i % 2 else "quite another text") for i in range(5)], "item_id long, text string")
    monkeypatch.setattr(C, "ITEMS_AT_ONCE", 2)
    assert sorted((r.doc_id, r.item_id, r.distance) for r in C.contaminated(df, bench).collect()) == [(1, 1, 0), (1, 1, 0), (1, 3, 0), (1, 3, 0)]
    assert C.contaminated(df.limit(0), bench).count() == 0
    assert C.contaminated(df, bench.limit(0)).count() == 0


def test_keys_of_any_type(spark, monkeypatch):
    df = spark.createDataFrame([("a", "some words about nothing much"), (None, "words about nothing")], "doc_id string, text string")
    bench = spark.createDataFrame([("i1", "words about nothing"), ("i2", "quite another text")], "item_id string, text string")
    for most in (8_000_000, 5):
        monkeypatch.setattr(C, "CHARACTERS_AT_ONCE", most)
        assert sorted((r.doc_id or "", r.item_id, r.distance) for r in C.contaminated(df, bench).collect()) == [("", "i1", 0), ("a", "i1", 0)]
        assert C.uncontaminated(df, bench).count() == 0


def test_short_items_are_no_evidence(spark):
    """An item of under LEAST characters, normalised, matches nothing and empties no corpus, unless the caller asks for it."""
    items = spark.createDataFrame([(1, "a"), (2, " An   item of 15 "), (3, "An item as of 16")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "banana bread"), (2, "so an item of 15 it is"), (3, "so an item as of 16 it is")], "doc_id long, text string")
    assert [len(C.normalised(r.text)) for r in items.orderBy("item_id").collect()] == [1, 13, 16]
    assert [(r.doc_id, r.item_id) for r in C.contaminated(docs, items, rate=0.0).collect()] == [(3, 3)]
    assert sorted(r.doc_id for r in C.uncontaminated(docs, items, rate=0.0).collect()) == [1, 2]
    assert {(r.doc_id, r.item_id) for r in C.contaminated(docs, items, least=1, rate=0.0).collect()} == {(1, 1), (2, 1), (3, 1), (2, 2), (3, 3)}
