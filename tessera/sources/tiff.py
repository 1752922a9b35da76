"""TIFF tables (S01-S12, S18, K01, C15, C16): files are read by Spark's binaryFile source, wherever they are.

Each function returns one relation; what it doesn't need isn't decoded.  A damaged file gives
rows with an error instead of failing the job.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import tiff_format as T

MODEL_SCALE, TIEPOINTS, GEO_DIRECTORY, GEO_DOUBLES, GEO_ASCII, NODATA = 33550, 33922, 34735, 34736, 34737, 42113
XMP, EXIF, GPS = 700, 34665, 34853
BATCH_ROWS, BATCH_BYTES = 4096, 4 << 20  # of a table's rows that leave a task at once
KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()), "array<tinyint>": pa.list_(pa.int8())}


def files(spark: SparkSession, path: str, glob: str = "*.{[tT][iI][fF],[tT][iI][fF][fF]}") -> DataFrame:
    """(path, content) of all files below path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "content")


def _table(df: DataFrame, schema: str, rows: Callable[[bytes], Iterator[tuple]]) -> DataFrame:
    kinds = [(c.split()[0], KINDS[c.split()[1]]) for c in f"path string, {schema}".split(", ")]

    def made(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, kind, from_pandas=True) for column, (_, kind) in zip(zip(*held, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0  # many small files share a batch, a large one has several
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):  # one file at a time: files are large
                if not content.is_valid:
                    continue
                path = path.as_py()
                for row in rows(content.as_py()):
                    held.append((path, *row))
                    size += sum(v.nbytes if isinstance(v, np.ndarray) else len(v) for v in row if isinstance(v, (np.ndarray, str, list)))
                    if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield made(held)
                        held, size = [], 0
        if held:
            yield made(held)

    return df.select(F.col("path").cast("string").alias("path"), "content").mapInArrow(run, f"path string, {schema}")


def _walk(data: bytes) -> Iterator[tuple[int, dict[int, tuple] | None, str | None]]:
    i = -1
    try:
        for i, tags in enumerate(T.directories(data)):
            yield i, tags, None
    except T.DAMAGE as e:
        yield i + 1, None, str(e) or type(e).__name__


def _one(tags: dict[int, tuple], tag: int, default=None):
    return (tags.get(tag) or (default,))[0]


def ifds(df: DataFrame) -> DataFrame:
    """An image directory a row."""

    def rows(data: bytes) -> Iterator[tuple]:
        for i, t, error in _walk(data):
            if t is None:
                yield (i, *[None] * 14, error)
                continue
            counts = t.get(T.TILE_COUNTS) or t.get(T.STRIP_COUNTS) or ()
            yield (i, _one(t, 254, 0), _one(t, T.WIDTH), _one(t, T.HEIGHT), _one(t, T.BITS, 1), _one(t, T.SAMPLES, 1), _one(t, T.SAMPLE_FORMAT, 1), _one(t, T.COMPRESSION, 1), _one(t, T.PHOTOMETRIC), _one(t, T.PREDICTOR, 1), _one(t, T.TILE_WIDTH), _one(t, T.TILE_HEIGHT), _one(t, T.ROWS_PER_STRIP), t[-1][0], int(sum(counts)), None)

    return _table(df, "ifd int, subfile long, width long, height long, bits int, samples int, sample_format int, compression int, photometric int, predictor int, tile_w long, tile_h long, rows_per_strip long, ifd_offset long, bytecount long, error string", rows)


def _shown(code: int, values: tuple) -> str:
    if code == XMP and values and isinstance(values[0], int):
        values = (bytes(v & 255 for v in values),)
    if values and isinstance(values[0], bytes):
        raw = b"".join(values).rstrip(b"\0")
        undefined = len(values) == 1 and code not in (XMP, NODATA) and not raw.decode("latin-1").isprintable()
        return f"{len(raw)} bytes" if undefined else raw.decode("utf-8", "replace")
    return ", ".join(f"{v[0]}/{v[1]}" if isinstance(v, tuple) else str(v) for v in values)


def tags(df: DataFrame) -> DataFrame:
    """A tag a row; values as text, long arrays whole, rationals as numerator/denominator, other bytes by their number."""

    def rows(data: bytes) -> Iterator[tuple]:
        for i, t, _ in _walk(data):
            for code, values in sorted((t or {}).items()):
                if code <= 0:
                    continue
                text = _shown(code, values)
                yield i, code, 1 if values and isinstance(values[0], bytes) or code == XMP else len(values), text

    return _table(df, "ifd int, code int, n int, value string", rows)


def exif(df: DataFrame) -> DataFrame:
    """A tag a row of the camera (EXIF) and place (GPS) sub-directories: numbers, denominators of rationals, text.

    functions.exif.shown formats them.  A damaged sub-directory has no rows.
    """

    def rows(data: bytes) -> Iterator[tuple]:
        for i, t, _ in _walk(data):
            for part in (EXIF, GPS):
                for code, values in sorted(T.sub_directory(data, t or {}, part).items()):
                    if code <= 0 or not values:
                        continue
                    pairs = isinstance(values[0], tuple)
                    text = b"".join(values).rstrip(b"\0").decode("utf-8", "replace") if isinstance(values[0], bytes) else None
                    numbers = None if text is not None else [float(v[0] if pairs else v) for v in values]
                    yield i, part, code, numbers, [float(v[1]) for v in values] if pairs else None, text

    return _table(df, "ifd int, part int, code int, numbers array<double>, denominators array<double>, text string", rows)


def geo(df: DataFrame) -> DataFrame:
    """S07's input and the georeference (P15, P19): key directory, doubles and text of each directory, affine transform and nodata."""

    def rows(data: bytes) -> Iterator[tuple]:
        for i, t, _ in _walk(data):
            t = t or {}
            affine = None
            if MODEL_SCALE in t and TIEPOINTS in t:
                sx, sy, (px, py, _, x, y, _) = t[MODEL_SCALE][0], t[MODEL_SCALE][1], t[TIEPOINTS][:6]
                affine = [x - px * sx, sx, 0.0, y + py * sy, 0.0, -sy]
            yield i, list(map(int, t[GEO_DIRECTORY])) if GEO_DIRECTORY in t else None, list(map(float, t[GEO_DOUBLES])) if GEO_DOUBLES in t else None, _text(t, GEO_ASCII), affine, _nodata(t)

    return _table(df, "ifd int, directory array<int>, doubles array<double>, ascii string, affine array<double>, nodata double", rows)


def is_georeferenced(geo_rows: DataFrame) -> DataFrame:
    """Paths of files whose first directory has a key directory with an entry."""
    return geo_rows.where((F.col("ifd") == 0) & (F.coalesce(F.get("directory", F.lit(3)), F.lit(0)) > 0)).select("path")


def blocks(df: DataFrame) -> DataFrame:
    """Strips and tiles: place, offset, size; leader: the 4 bytes before the block as a number (C15), trailer_ok: the 4 after it repeat its last 4."""

    def rows(data: bytes) -> Iterator[tuple]:
        for i, t, _ in _walk(data):
            if t is None:
                continue
            tiled = T.TILE_OFFSETS in t
            at, sizes = (t[T.TILE_OFFSETS], t.get(T.TILE_COUNTS, ())) if tiled else (t.get(T.STRIP_OFFSETS, ()), t.get(T.STRIP_COUNTS, ()))
            across = max(1, -(-_one(t, T.WIDTH, 0) // _one(t, T.TILE_WIDTH, 1))) if tiled else 1
            h = _one(t, T.TILE_HEIGHT, 1) if tiled else _one(t, T.ROWS_PER_STRIP, _one(t, T.HEIGHT, 1))
            down = max(1, -(-_one(t, T.HEIGHT, 0) // max(1, h)))
            for n, (offset, size) in enumerate(zip(at, sizes, strict=False)):
                plane, rest = divmod(n, across * down)
                leader = struct.unpack("<I", data[offset - 4 : offset])[0] if offset >= 4 else None
                end = offset + size
                yield i, plane + 1, rest % across, rest // across, n, offset, size, leader, size >= 4 and data[end : end + 4] == data[end - 4 : end]

    return _table(df, "ifd int, band int, bx int, by int, block int, offset long, bytecount long, leader long, trailer_ok boolean", rows)


def _text(tags: dict[int, tuple], tag: int) -> str | None:
    return b"".join(tags[tag]).rstrip(b"\0").decode("utf-8", "replace") if tag in tags else None


def _nodata(tags: dict[int, tuple]) -> float | None:
    try:
        return float(_text(tags, NODATA) or "")
    except ValueError:
        return None


def pixels(df: DataFrame) -> DataFrame:
    """Bands as rows of samples: (path, ifd, band, row, nodata, data array<double>, hidden array<tinyint>, error).

    nodata is the first directory's.  hidden: for each sample 1 if the directory's mask, that of
    equal size behind it, is 0 there, plus 2 if its alpha sample is 0 and this isn't the alpha
    band; null where nothing is hidden.  A damaged directory is a row with an error.
    """

    def rows(data: bytes) -> Iterator[tuple]:
        nodata, found = None, list(_walk(data))
        for i, t, error in found:
            if t is None:
                yield i, None, None, nodata, None, None, error
                continue
            nodata = _nodata(t) if i == 0 else nodata
            try:
                image = T.page_image(T.read_page(data, t, i))
                size = image.shape[:2]
                mask = next((m for k, m, _ in found if k > i and m and T.is_mask(m) and (_one(m, T.HEIGHT), _one(m, T.WIDTH)) == size), None)
                hidden = np.zeros(size, np.int8)
                if mask is not None and not T.is_mask(t):
                    hidden += (T.page_image(T.read_page(data, mask, 0))[:, :, 0] == 0).astype(np.int8)
            except T.DAMAGE as e:
                yield i, None, None, nodata, None, None, str(e) or type(e).__name__
                continue
            alpha = T.alpha_band(t)
            clear = None if alpha is None else (image[:, :, alpha] == 0).astype(np.int8) * 2
            for band in range(image.shape[2]):
                flags = hidden if clear is None or band == alpha else hidden + clear
                some = flags.any(axis=1)
                for row, values in enumerate(image[:, :, band].astype(np.float64)):
                    yield i, band + 1, row, nodata, values, flags[row] if some[row] else None, None

    return _table(df, "ifd int, band int, row int, nodata double, data array<double>, hidden array<tinyint>, error string", rows)


def masked_pixels(spark: SparkSession, path: str) -> DataFrame:
    """The pixel relation that the statistics read: see pixel_view."""
    return pixel_view(files(spark, path), spark.sparkContext.defaultParallelism)


def pixel_view(content: DataFrame, parts: int | None = None) -> DataFrame:
    """(file_id, ifd, band, row, col, value, is_nodata, is_masked, is_alpha0) of files (path, content); damaged directories have no pixels.

    A file is decoded by one task; its rows are dealt out over parts before they become pixels.
    """
    rows = pixels(content).where("error is null")
    rows = rows if parts is None else rows.repartition(parts)
    cell = lambda v, h: F.struct(v.alias("value"), h.alias("hidden"))
    cells = F.when(F.col("hidden").isNull(), F.transform("data", lambda v: cell(v, F.lit(0).cast("tinyint")))).otherwise(F.zip_with("data", "hidden", cell))
    long = rows.select("path", "ifd", "band", "row", "nodata", F.posexplode(cells).alias("col", "cell"))
    value, hidden = F.col("cell.value"), F.col("cell.hidden")
    none = F.coalesce(value == F.col("nodata"), F.lit(False))
    return long.select(F.col("path").alias("file_id"), "ifd", "band", "row", "col", value.alias("value"), none.alias("is_nodata"), (hidden.bitwiseAND(F.lit(1)) != 0).alias("is_masked"), (hidden.bitwiseAND(F.lit(2)) != 0).alias("is_alpha0"))


def encoded(df: DataFrame, width: int, data: str = "data", out: str = "content", layout: T.Layout | None = None, dtype: str = "<f4") -> DataFrame:
    """Df with each array of samples, row by row, as a one-page file of its own; null arrays stay null."""
    form = layout or T.Layout()

    @F.pandas_udf("binary")
    def make(column: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else T.write_tiff([(np.asarray(x, dtype).reshape(-1, width), form)]) for x in column], dtype=object)

    return df.withColumn(out, make(F.col(data)))
