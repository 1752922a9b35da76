import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from tessera.llm import decontaminate as C, deobfuscate as D, mixing, queries
from tests.llm.test_shingles import plain_set, similarity
from tests.llm.test_simhash import least_labels

SF01 = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """Rows of documents and after each stage."""
    top = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    out = [docs.collect()]
    for name, stage in P.STAGES:
        stage(spark, docs, SF01).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
        out.append(docs.collect())
        assert name == P.STAGES[-1][0] or docs.columns == COLUMNS
    return out


def ids(rows):
    return [r.doc_id for r in rows]


def test_toxicity_stage(spark, kept):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    gone = set(ids(kept[0])) - set(ids(kept[1]))
    toxic = [d for d in ids(kept[0]) if labels.get(d) == 1]
    clean = [d for d in ids(kept[0]) if labels.get(d) == 0]
    assert sum(d in gone for d in toxic) > 0.7 * len(toxic) and sum(d in gone for d in clean) < 0.02 * len(clean)
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    model, weights = queries.fitted_toxicity(spark, SF01, docs)
    by = D.Restorer(model)
    score = {r.doc_id: 1 / (1 + np.exp(-weights[by.positions(r.text)].sum(dtype=np.float64))) for r in kept[0]}
    assert gone == {d for d, s in score.items() if s >= 0.3}


def test_near_dedup_stage(kept):
    """All pairs of the stage's input at a similarity of 0.8 on five words."""
    sets = {r.doc_id: plain_set(r.text) for r in kept[1]}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])) and similarity(sets[a], sets[b]) >= 0.8]
    labels = least_labels(sets, links)
    assert sorted(ids(kept[2])) == sorted(d for d in sets if labels[d] == d)


def test_decontamination_stage(spark, kept):
    items = [C.normalised(r.text) for r in spark.read.parquet(f"{SF01}/benchmark.parquet").collect()]
    left = set(ids(kept[3]))
    for r in kept[2]:
        plain = C.normalised(r.text)
        if any(x in plain for x in items):
            assert r.doc_id not in left
        elif r.doc_id not in left:
            assert min(C.best_end(x, plain)[0] / len(x) for x in items) <= 0.08


def test_mixing_stage(spark, kept):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    before, after = ids(kept[3]), ids(kept[4])
    times = {d: after.count(d) for d in before}
    clean = [times[d] for d in before if labels.get(d) == 1]
    low = [times[d] for d in before if labels.get(d) == 0]
    assert np.mean([t > 0 for t in clean]) > 0.98 and np.mean(low) < 0.8 and set(after) <= set(before)
    texts = {r.doc_id: r.text for r in kept[3]}
    assert all(r.text == texts[r.doc_id] for r in kept[4])


def test_token_stage(kept):
    library = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in kept[4]}
    assert sorted(ids(kept[5])) == sorted(ids(kept[4]))
    start = 0
    for r in sorted(kept[5], key=lambda r: r.start):
        packed = np.array([*library.encode(texts[r.doc_id], add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(packed), zlib.crc32(packed.tobytes()))
        start += len(packed)
    assert [r.doc_id for r in sorted(kept[5], key=lambda r: r.start)] == sorted(ids(kept[5]))


def test_hard_tables(spark, tmp_path):
    rows = [(None, "clean words here", "en", "a", 1), (None, None, "en", "a", 0), (4, "same words as before now", "en", "a", 1), (4, "same words as before now", "en", "a", 1), (7, "", "en", None, 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert P.near_dedup(spark, docs, str(tmp_path)).count() == 4
    assert P.decontamination(spark, docs, str(tmp_path)).count() == 5
    assert P.mix(spark, docs, str(tmp_path)).count() == 5
    got = P.token_output(spark, docs, str(tmp_path))
    assert got.count() == 5 and got.where(F.col("doc_id").isNull()).count() == 2
    none = docs.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
    assert mixing.solved([[2.0, 0.0], [0.0, 4.0]])[1][1] == pytest.approx(0.25)


def test_without_labels_nothing_is_toxic(spark, tmp_path):
    """Empty labels, labels of other documents, and labels without a value reject nothing and change nothing."""
    docs = spark.read.parquet(f"{SF01}/documents.parquet").limit(60)
    for i, rows in enumerate(([], [(-5, 1, 1)], [(1, None, None), (2, None, None)])):
        spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{i}/labels.parquet")
        assert P.toxicity(spark, docs, f"{tmp_path}/{i}").count() == 60
        assert P.mix(spark, docs, f"{tmp_path}/{i}").count() == 60


def test_columns_of_any_name_pass(spark, tmp_path):
    names = ["score", "_score", "rate", "Copies", "n_tokens", "posterior", "text_hash", "fp", "doc", "key", "node", "domain", "y", "ids", "shard", "drawn_by"]
    docs = spark.read.parquet(f"{SF01}/documents.parquet").limit(30)
    for i, name in enumerate(names):
        docs = docs.withColumn(name, F.lit(i) + F.col("doc_id"))
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    want = {r.doc_id: r for r in docs.collect()}
    for name, stage in P.STAGES[:-1]:
        got = stage(spark, docs, SF01)
        assert got.columns == docs.columns, name
        rows = got.collect()
        assert rows and all(r == want[r.doc_id] for r in rows), name
    assert P.token_output(spark, docs, SF01).count() == 30
