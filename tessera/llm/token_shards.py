"""Token-ID shards: one zstandard frame for each document, seekable from the end (operator 10).

A shard is a file in the public seekable zstandard layout:

    frame ... frame | document keys | seek table

Every document is an independent zstandard frame (with the frame's own checksum) of its ids as
little-endian unsigned 16- or 32-bit integers.  The last two parts are skippable frames, so any
zstandard tool still reads the file.  The seek table lists each frame's compressed size, plain
size and the low 32 bits of the XXH64 of its plain bytes; its footer holds the number of frames.
A reader fetches the tail, then only the bytes of the frames it wants.

Ranges of the order by key are cut so that each has about as many bytes of text; a task sorts its
range and streams it into shards, one after the other, none over a fixed size.  The cuts come from a sample that the driver weighs, as Spark's own range partitioning does, but of
keys, digests and lengths alone, so no text is encoded for it.
"""

from __future__ import annotations

import os
import re
import struct
from bisect import bisect_left, bisect_right
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import Sent, batches_of, kept_by, local_file, new_path, written

# Fixed values of the seekable layout.
SEEK_TABLE_FRAME, SEEKABLE_MAGIC, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
KEYS_FRAME = 0x184D2A50  # a skippable frame of this format's own: id width, rows without a key, then the keys
KEYS_HEAD = struct.Struct("<BQ")

SHARD_BYTES = 32 << 20  # text of a range, about
WIDE = 4  # a file has so many times as many bytes of ids at most, unless one document has more
MOST_RANGES = 65_536  # tasks that sort; beyond that their ranges grow and fill several files each
SAMPLED = 60  # rows of the sample for each range

PIECES_KEPT = 300_000  # pieces whose ids a worker remembers
AT_ONCE = 500  # documents handed to a worker at a time

# Texts that the fast path leaves to the library: code points whose case mapping, composition
# or class could differ between libraries (also two letters below U+0250 whose small form lies
# beyond the block of phonetic letters), and the special tokens' first two characters.
_UNUSUAL = re.compile("[^\x00-\x1b\x20-įı-ȹȻ-Ƚȿ-ɏ]|<\\|")
_LETTERS = "a-zªµºß-öø-ʯ"  # small forms of all letters of the fast path: up to U+02AF
_PIECES = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[0-9²³¹¼-¾]|[^\\s0-9²³¹¼-¾{_LETTERS}]+")


class Pieces(dict):
    """Piece -> its packed ids, merged by the library's model when the piece is first met."""

    def __init__(self, model, width: int):
        self.model, self.form = model, {2: "H", 4: "I"}[width]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        self.shown = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}  # the model's sign for each byte

    def __missing__(self, piece: str) -> bytes:
        signs = piece.encode().decode("latin-1").translate(self.shown)
        ids = [t.id for t in self.model.tokenize(signs)]
        self[piece] = packed = struct.pack(f"<{len(ids)}{self.form}", *ids)
        return packed


class Encoder:
    """Ids of texts under a lower-casing word BPE, remembered by piece.

    The tokenizer cuts a lower-cased text into pieces that are merged alone, so a text's ids
    are its pieces' ids in order.  Pieces are cut here and each distinct one is merged once
    by the library; texts with unusual characters go to the library whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kept = Pieces(self.tokenizer.model, self.width)
        with open(path, encoding="utf-8") as f:
            self.by_piece = "\"pattern\":{\"Regex\":\"'s|'t|'re|'ve|'m|'ll|'d|" in re.sub(r"\s", "", f.read())

    def packed(self, ids: list[int]) -> bytes:
        return np.asarray(ids, f"<u{self.width}").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.kept) > PIECES_KEPT:
            self.kept.clear()
        of, found = self.kept.__getitem__, [b""] * len(texts)
        rest = []
        for i, text in enumerate(texts):
            if self.by_piece and not _UNUSUAL.search(text):
                found[i] = b"".join(map(of, _PIECES.findall(text.lower())))
            else:
                rest.append(i)
        for at in range(0, len(rest), 100):
            part = rest[at : at + 100]
            for i, e in zip(part, self.tokenizer.encode_batch([texts[i] for i in part], add_special_tokens=False), strict=True):
                found[i] = self.packed(e.ids)
        return found


def encoder_of(tokenizer: str) -> Encoder:
    """This worker's encoder."""
    kept = kept_by("token_shards")
    return kept.get(tokenizer) or kept.setdefault(tokenizer, Encoder(local_file(tokenizer)))


def with_ids(df: DataFrame, tokenizer: str, end_id: int | None, text: str = "text", out: str = "ids") -> DataFrame:
    """df with each whole text's ids, and end_id after them, as packed little-endian integers; null texts count as empty."""

    @F.pandas_udf("binary")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = encoder_of(tokenizer)
        end = b"" if end_id is None else encoder.packed([end_id])
        for batch in batches:
            texts = batch.fillna("").tolist()
            yield pd.Series([x + end for at in range(0, len(texts), 500) for x in encoder.encode(texts[at : at + 500])], dtype=object)

    return df.withColumn(out, ids(F.col(text).cast("string")))


def id_width(tokenizer: str) -> int:
    return Encoder(tokenizer).width


def shard_file(shard: int, file: int = 0) -> str:
    """Name of a range's file; those after the first have a number of their own."""
    return f"shard-{shard:08d}{f'-{file:06d}' if file else ''}.ids.zst"


class ShardWriter:
    """Writes one shard beside its final name and renames it at the end, so a task that is run again replaces it whole."""

    def __init__(self, folder: str, shard: int, width: int, file: int = 0):
        self.files, root = fs.FileSystem.from_uri(folder)
        self.files.create_dir(root, recursive=True)
        self.path, self.width, self.bytes = f"{root}/{shard_file(shard, file)}", width, 0
        self.part = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.files.open_output_stream(self.part)
        self.zstd = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.table, self.keys, self.keyless = [], [], 0

    def add(self, key: int | None, ids: bytes) -> None:
        """Rows without a key come before all others."""
        frame = self.zstd.compress(ids)
        self.out.write(frame)
        self.bytes += len(ids)
        self.table.append(struct.pack("<III", len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))
        self.keyless += key is None
        self.keys.append(key or 0)

    def close(self) -> None:
        keys = KEYS_HEAD.pack(self.width, self.keyless) + np.asarray(self.keys, "<i8").tobytes()
        self.out.write(struct.pack("<II", KEYS_FRAME, len(keys)) + keys)
        table = b"".join(self.table) + struct.pack("<IBI", len(self.table), CHECKSUMS, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SEEK_TABLE_FRAME, len(table)) + table)
        self.out.close()
        self.files.move(self.part, self.path)


class ShardReader:
    """Random access to the documents of one shard."""

    def __init__(self, folder: str, shard: int, file: int = 0):
        files, root = fs.FileSystem.from_uri(folder)
        self.file = files.open_input_file(f"{root}/{shard_file(shard, file)}")
        size = self.file.size()
        frames, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC or flags != CHECKSUMS:
            raise ValueError("not a seekable shard")
        length = 12 * frames + 9
        self.table = np.frombuffer(self.file.read_at(12 * frames, size - length), "<u4").reshape(-1, 3)
        tail = 8 * frames + KEYS_HEAD.size
        keys = self.file.read_at(tail, size - length - 8 - tail)
        self.width, self.keyless = KEYS_HEAD.unpack_from(keys)
        self.keys = np.frombuffer(keys, "<i8", offset=KEYS_HEAD.size)  # of rows without a key: 0
        self.at = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        self.tokens = self.table[:, 1].astype(np.int64) // self.width
        self.zstd = zstandard.ZstdDecompressor()

    def read(self, i: int) -> np.ndarray:
        """Ids of the i-th document: one ranged read, one frame, both checksums checked."""
        packed, size, check = (int(x) for x in self.table[i])
        plain = self.zstd.decompress(self.file.read_at(packed, int(self.at[i])), max_output_size=max(1, size))
        if len(plain) != size or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {i} is damaged")
        return np.frombuffer(plain, f"<u{self.width}")


def shard_cuts(df: DataFrame, key: str = "key", tie: str = "tie", size: str = "size", shard_bytes: int = SHARD_BYTES, seed: int = 5) -> list[tuple[bool, int, int]]:
    """Places (has a key, key, tie) between the shards of df, in order; a place is repeated where its rows alone fill shards.

    Two passes over the three columns: the sum of sizes, which gives the number of shards, and
    a sample of SAMPLED rows a shard, whose sizes are halved and quartered by weight.
    """
    whole = df.agg(F.count("*").alias("n"), F.sum(F.col(size).cast("double")).alias("bytes")).first()
    shards = min(MOST_RANGES, round((whole.bytes or 0) / shard_bytes))
    if shards < 2:
        return []
    rows = df.sample(min(1.0, SAMPLED * shards / whole.n), seed).select(F.col(key).isNotNull().alias("has"), F.coalesce(key, F.lit(0)).alias("k"), F.col(tie).alias("t"), F.coalesce(size, F.lit(0)).alias("s"))
    sample = rows.toArrow()  # 100 MB at most
    if not sample.num_rows:
        return []
    has, k, t, s = (sample[c].to_numpy() for c in ("has", "k", "t", "s"))
    order = np.lexsort((s, t, k, has))
    upto = np.cumsum(s[order] + 1.0)
    at = order[np.searchsorted(upto, upto[-1] * np.arange(1, shards) / shards)]
    return list(zip(has[at].tolist(), k[at].tolist(), t[at].tolist(), strict=True))


class Placer:
    """The shard of a row (has a key, key, tie): that between the cuts around it.

    Rows that are equal to a repeated cut are alike and may lie in any of the shards that it
    stands for: each task deals its own out in turn.  How many go where depends on their number
    alone, so a task that is run again deals as many to each.
    """

    def __init__(self, cuts: list[tuple[bool, int, int]]):
        self.cuts, self.dealt = cuts, {}

    def shard(self, key: int | None, tie: int) -> int:
        place = (key is not None, key or 0, tie)
        low = bisect_left(self.cuts, place)
        if low < len(self.cuts) and self.cuts[low] == place:
            wide = bisect_right(self.cuts, place, low) - low + 1
            turn = self.dealt[place] = self.dealt.get(place, -1) + 1
            low += turn % wide
        return low


def _dealt(rows: DataFrame, cuts: list[tuple[bool, int, int]], make) -> DataFrame:
    """(shard, key, tie, ids) of rows (key, tie, value) by shard and in order within; make: a list of values to their packed ids."""
    sent = Sent(rows.sparkSession, cuts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        placer = Placer(sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                shards = [placer.shard(k, t) for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                ids = make(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), part.column(0), part.column(1), pa.array(ids, pa.binary())], names=["shard", "key", "tie", "ids"])

    dealt = rows.mapInArrow(deal, "shard int, key long, tie long, ids binary").repartitionById(len(cuts) + 1, F.col("shard"))
    return dealt.sortWithinPartitions("shard", F.col("key").asc_nulls_first(), "tie").drop("tie")


def write_shards(df: DataFrame, folder: str, width: int, key: str = "doc_id", ids: str = "ids", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes df's packed ids into shards in ascending key order, rows without a key first; returns (shard, file, n_docs, n_tokens).

    Keys are whole numbers.  A digest of the ids orders the rows of one key, so that a key's
    rows, however many, can be spread over shards.  df is read three times.
    """
    rows = df.select(F.col(key).cast("long").alias("key"), F.xxhash64(ids).alias("tie"), F.col(ids).alias("value"))
    cuts = shard_cuts(rows.select("key", "tie", F.octet_length("value").alias("size")), shard_bytes=shard_bytes)
    return _shards(_dealt(rows, cuts, lambda values: values), folder, width, WIDE * shard_bytes)


def _shards(dealt: DataFrame, folder: str, width: int, most: int) -> DataFrame:
    """Writes rows (shard, key, ids), a range's together and in order; they stream through its task, frame by frame, into files of most bytes of ids."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, file, tokens = None, None, 0, 0
        done: list[tuple[int, int, int, int]] = []

        def finish() -> None:
            out.close()
            done.append((now, file, len(out.keys), tokens))

        for batch in batches:
            for shard, k, packed in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if shard != now or out.bytes + len(packed) > most and out.bytes:
                    if out:
                        finish()
                    file = file + 1 if shard == now else 0
                    out, now, tokens = ShardWriter(folder, shard, width, file), shard, 0
                out.add(k, packed)
                tokens += len(packed) // width
        if out:
            finish()
        yield pa.RecordBatch.from_pydict({n: pa.array([d[i] for d in done], t) for i, (n, t) in enumerate((("shard", pa.int32()), ("file", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())))})

    with batches_of(dealt.sparkSession, AT_ONCE):
        return written(dealt.mapInArrow(write, "shard int, file int, n_docs long, n_tokens long"), "shards")


def read_shards(shards: DataFrame, folder: str, key: str = "doc_id", wanted: list[int] | None = None) -> DataFrame:
    """(key, start, n_tokens, ids) read back from the files; start: ids of all documents before it.

    With wanted, only the frames of those keys are read and decompressed.  Files are counted up
    within their range, and ranges, of which there are MOST_RANGES at most, by one window.
    """
    def before(of: Window) -> Column:
        return F.coalesce(F.sum("n_tokens").over(of.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    ranges = shards.groupBy("shard").agg(F.sum("n_tokens").alias("n_tokens")).select("shard", before(Window.orderBy("shard")).alias("ahead"))
    first = F.col("ahead") + before(Window.partitionBy("shard").orderBy("file"))
    listed = shards.join(F.broadcast(ranges), "shard").select("shard", "file", first.alias("first")).repartition(max(1, shards.count()))  # a row for each file
    want = None if wanted is None else np.unique(np.asarray(wanted, np.int64))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, file, first in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                reader = ShardReader(folder, shard, file)
                starts = first + np.cumsum(reader.tokens) - reader.tokens
                chosen = np.arange(len(reader.keys)) if want is None else np.flatnonzero(np.isin(reader.keys, want) & (np.arange(len(reader.keys)) >= reader.keyless))
                for at in range(0, len(chosen), 1000):
                    part = chosen[at : at + 1000]
                    none = part < reader.keyless
                    ids = [reader.read(int(i)).astype("<u4").tobytes() for i in part]
                    yield pa.RecordBatch.from_pydict({key: pa.array(reader.keys[part], mask=none), "start": starts[part], "n_tokens": reader.tokens[part], "ids": pa.array(ids, pa.binary()), "ids_crc32": pa.array([zlib.crc32(x) for x in ids], pa.int64())})

    return listed.mapInArrow(read, f"`{key}` long, start long, n_tokens long, ids binary, ids_crc32 long")


def tokenized(df: DataFrame, tokenizer: str, end_id: int | None, key: str = "doc_id", text: str = "text", folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encodes df's whole texts, writes the shards to folder and reads them back: see read_shards.

    df is read more than once and must give the same rows each time, as a table does.  Null and
    empty texts have the end id alone; an empty df leaves no shard and no rows; rows of one key
    have each their own frame.  Keys are whole numbers, or texts of such.  Other columns of df
    don't matter.
    """
    folder = folder or new_path(df.sparkSession, "token-shards")
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = df.select(F.col(key).cast("long").alias("key"), whole.alias("text"))
    cuts = shard_cuts(rows.select("key", F.xxhash64("text").alias("tie"), F.octet_length("text").alias("size")), shard_bytes=shard_bytes)
    end = None if end_id is None else [end_id]

    def encode(texts: list[str]) -> list[bytes]:
        encoder = encoder_of(tokenizer)
        last = b"" if end is None else encoder.packed(end)
        return [x + last for x in encoder.encode(texts)]

    dealt = _dealt(rows.select("key", F.xxhash64("text").alias("tie"), "text"), cuts, encode)
    return read_shards(_shards(dealt, folder, id_width(tokenizer), WIDE * shard_bytes), folder, key)
