"""Writes cloud-optimised TIFF files from tables of blocks (K01, K02, C05; C14 and C15 check what it writes).

Blocks are encoded where they are, one by one.  Their places follow from their sizes by a prefix sum
in two steps, within runs of RUN blocks and over the runs.  A file's directories then stand before
its data, levels from the smallest to the largest, each block between its size and a
repetition of its last four bytes, as the structural-metadata header says.  A last pass streams
every file's header and blocks in order into a file of a name of its own, which is renamed at
the end: a repeated task replaces it whole, and a failed one removes what it wrote.

Encoding, the costly part, is spread by blocks; a file itself is one stream of one task, which
holds a batch of blocks at a time.  Files over 4 GB, or of option big, are BigTIFF.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import tiff_format as T
from .folders import kept

RUN = 65_536  # blocks whose sizes one window adds up
BATCH = 16  # blocks that a stream holds at a time
CLASSIC_LIMIT = (1 << 32) - (1 << 20)

# Fixed text of the structural-metadata header.
STRUCTURE = "LAYOUT=IFDS_BEFORE_DATA\nBLOCK_ORDER=ROW_MAJOR\nBLOCK_LEADER=SIZE_AS_UINT4\nBLOCK_TRAILER=LAST_4_BYTES_REPEATED\nKNOWN_INCOMPATIBLE_EDITION=NO\n "
GHOST = f"GDAL_STRUCTURAL_METADATA_SIZE={len(STRUCTURE):06d} bytes\n{STRUCTURE}".encode()


@dataclass(frozen=True)
class Form:
    """How blocks are stored."""

    dtype: str = "<f4"
    compression: int = T.DEFLATE
    predictor: int = 1
    level: int | None = None
    tile: int = 512
    nodata: float | None = None  # stands for NaN; integer types without it store 0
    big: bool | None = None  # None: as the size asks for
    extra: dict[int, tuple[str, tuple]] = field(default_factory=dict)  # tags of the first directory


def encoded_blocks(blocks: DataFrame, form: Form) -> DataFrame:
    """(path, level, band, by, bx, width, height, size, payload, error): blocks encoded one by one; size: with leader and trailer."""
    layout, dtype = T.Layout(form.compression, form.predictor, (form.tile, form.tile), level=form.level), np.dtype(form.dtype)
    missing = form.nodata if form.nodata is not None else np.nan if dtype.kind == "f" else 0

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), BATCH):
                part = batch.iloc[at : at + BATCH]
                sizes, payloads, errors = [], [], []
                for data in part["data"]:
                    values = np.frombuffer(data).reshape(form.tile, form.tile)
                    values = np.where(np.isnan(values), missing, values)
                    if dtype.kind in "iu":
                        values = np.rint(values)
                        low, high = np.iinfo(dtype).min, np.iinfo(dtype).max
                        if values.min() < low or values.max() > high:
                            sizes.append(0), payloads.append(None), errors.append(f"values beyond {dtype}")
                            continue
                    raw = T.encode_segment(values.astype(dtype)[:, :, None], layout)
                    sizes.append(len(raw) + 8), payloads.append(struct.pack("<I", len(raw)) + raw + raw[-4:].rjust(4, b"\0")), errors.append(None)
                yield part.drop(columns="data").assign(size=sizes, payload=payloads, error=errors)

    return blocks.mapInPandas(encode, "path string, level int, band int, by int, bx int, width long, height long, size long, payload binary, error string")


def placed(blocks: DataFrame, tile: int) -> DataFrame:
    """blocks (path, level, band, by, bx, width, size, ...) with n, their place in the file's order, and begin, the bytes of data before them."""
    across = F.ceil(F.col("width") / tile)
    inner = F.ceil(F.col("height") / tile) * across
    n = ((F.col("band") - 1) * inner + F.col("by") * across + F.col("bx")).cast("long")
    rows = blocks.withColumn("n", n).withColumn("run", F.floor(F.col("n") / RUN))
    within = Window.partitionBy("path", "level", "run").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy("path", "level", "run").agg(F.sum("size").alias("bytes"))
    over = Window.partitionBy("path").orderBy(F.col("level").desc(), "run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("path", "level", "run", F.coalesce(F.sum("bytes").over(over), F.lit(0)).alias("ahead"))
    own = rows.withColumn("own", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return own.join(runs, ["path", "level", "run"]).withColumn("begin", F.col("ahead") + F.col("own")).drop("run", "own", "ahead")


def header(levels: list[tuple[int, int, int, np.ndarray, np.ndarray]], bands: int, form: Form, extra: dict[int, tuple[str, tuple]], total: int) -> bytes:
    """All directories before the data, for levels (level, width, height, begins, sizes) from 0 on; begins count from the end of the header."""
    dtype = np.dtype(form.dtype)

    def build(big: bool, base: int) -> bytes:
        count, place, entry, wide = ("Q", "Q", "HHQ8s", 8) if big else ("H", "I", "HHI4s", 4)
        kinds = {"H": 3, "I": 4, "d": 12, "s": 2, "Q": 16}
        out = bytearray(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 0) if big else struct.pack("<2sHI", b"II", 42, 0))
        link = len(out) - wide
        out += GHOST + b"\0" * (len(GHOST) % 2)
        for level, width, height, begins, sizes in levels:
            offsets = (begins + base + 4).astype(np.uint64 if big else np.uint32)
            tags = {
                254: ("I", (1 if level else 0,)), T.WIDTH: ("I", (width,)), T.HEIGHT: ("I", (height,)), T.BITS: ("H", (dtype.itemsize * 8,) * bands), T.COMPRESSION: ("H", (form.compression,)),
                T.PHOTOMETRIC: ("H", (1,)), T.SAMPLES: ("H", (bands,)), T.PLANAR: ("H", (2 if bands > 1 else 1,)), T.PREDICTOR: ("H", (form.predictor,)), T.TILE_WIDTH: ("I", (form.tile,)),
                T.TILE_HEIGHT: ("I", (form.tile,)), T.SAMPLE_FORMAT: ("H", ({"u": 1, "i": 2, "f": 3}[dtype.kind],) * bands), T.TILE_OFFSETS: ("Q" if big else "I", offsets), T.TILE_COUNTS: ("I", (sizes - 8).astype(np.uint32)),
            }
            tags |= extra if level == 0 else {}
            struct.pack_into(f"<{place}", out, link, len(out))
            at = len(out) + struct.calcsize(f"<{count}") + len(tags) * struct.calcsize(f"<{entry}") + wide
            entries, values = b"", bytearray()
            for tag, (kind, v) in sorted(tags.items()):
                raw = bytes(v) if kind == "s" else v.tobytes() if isinstance(v, np.ndarray) else struct.pack(f"<{len(v)}{kind}", *v)
                n = len(v)
                if len(raw) > wide:
                    values += b"\0" * ((at + len(values)) % 2)
                    where = struct.pack(f"<{place}", at + len(values))
                    values += raw
                    raw = where
                entries += struct.pack(f"<{entry}", tag, kinds[kind], n, raw)
            out += struct.pack(f"<{count}", len(tags)) + entries
            link = len(out)
            out += b"\0" * wide + values
            out += b"\0" * (len(out) % 2)
        return bytes(out)

    size = len(build(True, 0))
    big = size + total > CLASSIC_LIMIT if form.big is None else form.big
    return build(big, len(build(big, 0)))


def written(blocks: DataFrame, folder: str, form: Form, name: Callable[[str], str] | None = None, tags: Callable[[str], dict[int, tuple[str, tuple]]] | None = None) -> DataFrame:
    """Writes a file for each path of blocks (see operators.overviews) into folder; returns (path, target, size, error).

    name: a path's place below folder, by default its last part with .tif; tags: a path's own tags, by default form.extra.
    A file with a block that its type can't hold has an error and isn't written.
    """
    if form.tile % 16:
        raise ValueError("tiles are multiples of 16")
    rows = kept(placed(kept(encoded_blocks(blocks, form), "encoded"), form.tile), "placed")
    name = name or (lambda path: path.rsplit("/", 1)[-1].rsplit(".", 1)[0] + ".tif")
    # A file's header holds the places of all its blocks by its nature: 16 bytes each.
    levels = rows.groupBy("path", "level").agg(F.first("width").alias("width"), F.first("height").alias("height"), F.max("band").alias("bands"), F.max("error").alias("error"), F.sort_array(F.collect_list(F.struct("n", "begin", "size"))).alias("places"))

    def headers(group: pd.DataFrame) -> pd.DataFrame:
        path, error = group["path"].iloc[0], next((e for e in group["error"] if e), None)
        head = b""
        if not error:
            try:
                found, total = [], 0
                for r in group.sort_values("level").itertuples():
                    begins, sizes = (np.array([p[c] for p in r.places], np.int64) for c in ("begin", "size"))
                    blocks_of_level = -(-r.width // form.tile) * -(-r.height // form.tile) * r.bands
                    if len(begins) != blocks_of_level:
                        raise ValueError(f"level {r.level} has {len(begins)} of {blocks_of_level} blocks")
                    found.append((int(r.level), int(r.width), int(r.height), begins, sizes))
                    total += int(sizes.sum())
                head = header(found, int(group["bands"].max()), form, form.extra if tags is None else tags(path), total)
            except (*T.DAMAGE, OSError) as e:
                error = f"{type(e).__name__}: {e}"
        return pd.DataFrame([(path, -1, head, error)], columns=["path", "begin", "payload", "error"])

    heads = levels.groupBy("path").applyInPandas(headers, "path string, begin long, payload binary, error string")
    pieces = rows.select("path", "begin", "payload", F.lit(None).cast("string").alias("error")).unionByName(heads)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        now = out = part = target = error = None
        size = 0
        done: list[tuple] = []

        def finish() -> None:
            if out is not None:
                out.close()
                files.move(part, target)
            done.append((now, None if error else target, None if error else size, error))

        try:
            for batch in batches:
                for path, payload, wrong in zip(*(batch.column(c) for c in ("path", "payload", "error")), strict=True):
                    if path.as_py() != now:
                        if now is not None:
                            finish()
                        now, error, size, out = path.as_py(), wrong.as_py(), 0, None
                        target = f"{root}/{name(now)}"
                        if not error:
                            files.create_dir(target.rsplit("/", 1)[0], recursive=True)
                            part = f"{target}.{uuid.uuid4().hex}.part"
                            out = files.open_output_stream(part)
                    if out is not None and payload.is_valid:
                        raw = payload.as_buffer()
                        out.write(raw)
                        size += raw.size
            if now is not None:
                finish()
                out = None
        except BaseException:
            if out is not None:
                out.close()
                files.delete_file(part)
            raise
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.string()))], names=["path", "target", "size", "error"])

    ordered = pieces.repartition("path").sortWithinPartitions("path", "begin")
    return kept(ordered.mapInArrow(stream, "path string, target string, size long, error string"), "targets")
