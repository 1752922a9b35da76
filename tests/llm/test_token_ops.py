import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe_transducer, queries, token_shards
from tessera.llm.shared import batches_of

ODD = ["", " ", "\n\n", "  a  \n\n b\t c  ", "don't we'll 're 'r 'x  'l 'll 'lx a'", "'s's''s   　x", "<|endoftext|>", "a<|endoftext|> b", "x" * 5000,
       "日本語 テスト１２３ ½ ²", "🙂🙂 hi", "I'M don'T 's t", "'rx 're'r 'v 've", " ' 'a ''a", "aaa" * 900, "İstanbul ΣΑΣ \x1c\x1d x", "é é ﬁ", "a b\u0085c", None]


def texts(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()
    return [r[0] for r in rows] + ODD


def test_counts_match_the_library(spark, sf):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    library, every = Tokenizer.from_file(path), texts(spark, sf)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(every)], "doc_id long, text string, n_chars string")
    got = {r.doc_id: r.n_tokens for r in bpe_transducer.token_counts(df, path, block_chars=1000).collect()}
    assert got == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(every)}
    replaced = bpe_transducer.token_counts(df, path, out="N_chars")
    assert len(replaced.columns) == 3 and {r.doc_id: r.N_chars for r in replaced.collect()} == got
    assert bpe_transducer.token_counts(df.limit(0), path).count() == 0


def test_splitter_does_not_depend_on_blocks(monkeypatch):
    points = np.array([ord(c) for c in "it's 12 'r  \n x''ll " * 40] + [0x110000], np.uint32)
    whole = bpe_transducer.piece_starts(points)
    monkeypatch.setattr(bpe_transducer, "BLOCK", 7)
    assert np.array_equal(whole, bpe_transducer.piece_starts(points))


def test_a_piece_of_any_length_keeps_few_states(monkeypatch):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    text = "".join(chr(97 + i) for i in np.random.default_rng(2).integers(0, 26, 60_000).tolist())
    monkeypatch.setattr(bpe_transducer, "STATES_KEPT", 500)
    monkeypatch.setattr(bpe_transducer, "_MERGERS", {})
    assert bpe_transducer.count_tokens([text, "a b"], path).tolist() == [len(Tokenizer.from_file(path).encode(t).ids) for t in (text, "a b")]
    assert len(bpe_transducer._MERGERS[path].states) <= 502


def test_shards_round_trip(spark, sf, tmp_path):
    path = queries.tokenizer_path("word_bpe_49k.json")
    library, every = Tokenizer.from_file(path), texts(spark, sf)
    keyed = [(7 * (len(every) - i), t) for i, t in enumerate(every)]
    df = spark.createDataFrame(keyed, "doc_id long, text string")
    folder = f"file://{tmp_path}/shards"
    rows = token_shards.tokenized(df, path, 2, folder=folder, shard_bytes=20_000).orderBy("doc_id").collect()
    start = 0
    for r, (key, text) in zip(rows, sorted(keyed, key=lambda x: x[0]), strict=True):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (key, start, len(ids), zlib.crc32(ids.tobytes()))
        assert bytes(r.ids) == ids.tobytes()
        start += len(ids)


def test_reader_takes_only_wanted_frames_and_sees_damage(tmp_path):
    folder = f"file://{tmp_path}"
    writer = token_shards.ShardWriter(folder, 0, 2)
    for k in range(20):
        writer.add(k, np.arange(k * 100, dtype="<u2").tobytes())
    writer.close()
    reader = token_shards.ShardReader(folder, 0)
    assert reader.read(7).tolist() == list(range(700)) and reader.read(0).size == 0
    file = tmp_path / "shard-00000000.ids.zst"
    import io

    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(file.read_bytes()), read_across_frames=True).read()
    assert hashlib.md5(whole).hexdigest() == hashlib.md5(b"".join(np.arange(k * 100, dtype="<u2").tobytes() for k in range(20))).hexdigest()
    data = bytearray(file.read_bytes())
    data[int(reader.at[7]) + 12] ^= 255
    file.write_bytes(bytes(data))
    with pytest.raises(Exception):
        token_shards.ShardReader(folder, 0).read(7)
    assert token_shards.ShardReader(folder, 0).read(8).size == 800


def test_shards_of_hard_tables(spark):
    path = queries.tokenizer_path("word_bpe_49k.json")
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_shards.tokenized(empty, path, 2).count() == 0
    df = spark.createDataFrame([(None, "a b"), (3, None), (3, "b"), (3, "b")], "doc_id long, text string")
    rows = sorted((r.start, r.doc_id, r.n_tokens) for r in token_shards.tokenized(df, path, 2).collect())
    assert rows == [(0, None, 3), (3, 3, 2), (5, 3, 2), (7, 3, 1)] or rows == [(0, None, 3), (3, 3, 1), (4, 3, 2), (6, 3, 2)]


def test_shards_are_cut_by_bytes_and_hot_keys_spread(spark, tmp_path):
    """A key, no key and one repeated row that hold most of the bytes each fill several shards; the order stays."""
    path = queries.tokenizer_path("word_bpe_49k.json")
    rng = np.random.default_rng(4)
    say = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 99, n))
    rows = [(int(k), say(30)) for k in rng.integers(-(1 << 63), (1 << 63) - 1, 300)] + [(None, say(30)) for _ in range(600)] + [(5, say(30)) for _ in range(400)] + [(7, "the same text over and over again")] * 900 + [(-(1 << 63), "least"), (None, None)]
    order = rng.permutation(len(rows)).tolist()
    spark.createDataFrame([rows[i] for i in order], "doc_id long, text string").repartition(7).write.parquet(f"{tmp_path}/docs")
    df = spark.read.parquet(f"{tmp_path}/docs")
    folder = f"file://{tmp_path}/shards"
    got = token_shards.tokenized(df, path, 2, folder=folder, shard_bytes=8_000).collect()
    got.sort(key=lambda r: r.start)
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert len(got) == len(rows) and keys == sorted(keys) and keys.count((True, -(1 << 63))) == 1
    starts = np.cumsum([r.n_tokens for r in got])
    assert [r.start for r in got[1:]] == starts[:-1].tolist()
    library = Tokenizer.from_file(path)
    want = sorted((k is not None, k or 0, zlib.crc32(np.array([*library.encode(t or "").ids, 2], "<u4").tobytes())) for k, t in rows)
    assert sorted((*k, r.ids_crc32) for k, r in zip(keys, got)) == want
    cuts = token_shards.shard_cuts(df.select(df.doc_id.alias("key"), F.xxhash64("text").alias("tie"), F.octet_length("text").alias("size")), shard_bytes=8_000)
    shards = len(list((tmp_path / "shards").glob("*.zst")))
    assert shards == len(cuts) + 1 > 10 and len(set(cuts)) < len(cuts) and sum(c[:2] == (True, 5) for c in cuts) > 1 and sum(not c[0] for c in cuts) > 1
    sizes = [len(token_shards.ShardReader(folder, i).keys) for i in range(shards)]
    assert max(sizes) < 4 * len(rows) / shards


def test_null_keys_are_no_number(tmp_path):
    folder = f"file://{tmp_path}"
    writer = token_shards.ShardWriter(folder, 3, 4)
    for k in (None, None, -(1 << 63), 0):
        writer.add(k, b"\1\0\0\0")
    writer.close()
    reader = token_shards.ShardReader(folder, 3)
    assert reader.keyless == 2 and reader.keys[2:].tolist() == [-(1 << 63), 0] and reader.read(3).tolist() == [1]


def same_as_the_libraries(texts):
    words, pairs = queries.tokenizer_path("word_bpe_49k.json"), queries.tokenizer_path("byte_bpe_50k.json")
    encoder = token_shards.Encoder(words)
    want = [encoder.packed(e.ids) for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [t for t, x, y in zip(texts, encoder.encode(texts), want, strict=True) if x != y] == []
    counts = [len(e.ids) for e in Tokenizer.from_file(pairs).encode_batch(texts, add_special_tokens=False)]
    assert [t for t, x, y in zip(texts, bpe_transducer.count_tokens(texts, pairs).tolist(), counts, strict=True) if x != y] == []


@pytest.mark.parametrize("around", ["{}", "a{}b", " {}'s", "x\n{}{}1 'll", "{}'ve"])
def test_every_code_point_below_3000(around):
    same_as_the_libraries([around.replace("{}", chr(c)) for c in range(0x3000)])


def test_random_strings_of_hard_signs():
    import random

    rng = random.Random(8)
    signs = ["'s", "'ll", "'re", "'ve", "'d", "'", "r", "v", "l", "e", " ", "\n", "\t", "\r", " ", " ", "\u0085", "a", "b", "Ɓ", "Ə", "Ʉ", "ɏ", "Ⱥ", "Ⱦ", "1", "½", "!", "\x00", "\x07", "\x1c", "\x7f", "é", "日", "<|", "̀", "İ", "ß", "Σ", "ﬁ"]
    same_as_the_libraries(["".join(rng.choices(signs, k=rng.randrange(1, 14))) for _ in range(10_000)])
    same_as_the_libraries(["x\n's", "a\t've", "x\n'd", "\n\n'll", "'r's", " 'll", "a\x00", "aƁb"])


def test_a_range_fills_several_files(spark, tmp_path, monkeypatch):
    """Where ranges are few, files stay as small; starts count through all of them."""
    monkeypatch.setattr(token_shards, "MOST_RANGES", 2)
    df = spark.createDataFrame([(i, f"some words of text {i} " * 20) for i in range(300)], "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/docs")
    folder, path = f"file://{tmp_path}/shards", queries.tokenizer_path("word_bpe_49k.json")
    got = sorted(token_shards.tokenized(spark.read.parquet(f"{tmp_path}/docs"), path, 2, folder=folder, shard_bytes=1_000).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in got] == list(range(300)) and [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
    files = sorted((tmp_path / "shards").glob("*.zst"))
    assert len(files) > 10 and len({f.name[:14] for f in files}) == 2
    sizes = [int(token_shards.ShardReader(folder, *(int(x) for x in f.name.split(".")[0].split("-")[1:])).table[:, 1].sum()) for f in files]
    assert max(sizes) <= 4_000


def test_batches_of(spark):
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    sizes = spark.range(0, 1000, 1, 1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows])}) for b in batches), "n long")
    try:
        spark.conf.set(setting, 400)
        with batches_of(spark, 100):
            assert {r.n for r in sizes.collect()} == {100}
        with batches_of(spark, 5000):  # a smaller setting of the session's stays
            assert spark.conf.get(setting) == "400"
        with pytest.raises(ValueError):
            with batches_of(spark, 100):
                raise ValueError
        assert spark.conf.get(setting) == "400"
    finally:
        spark.conf.set(setting, before)
