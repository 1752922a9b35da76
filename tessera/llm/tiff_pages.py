"""TIFF media columns: one row for every page of the files in a binary column (operator 3).

Tasks walk the chain of image directories of classic and big files in either byte order,
decode stored, PackBits, LZW and deflate strips and tiles, undo horizontal and floating-point
predictors, and lay the samples out row by row.  The format itself is in sources.tiff_format,
which the raster tables read with too.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.tiff_format import DEFLATE, LZW, PACKBITS, Layout, Page, read_pages, write_tiff

_PAGE = [("index", pa.int32()), ("width", pa.int64()), ("height", pa.int64()), ("samples", pa.int32()), ("bits", pa.int32()), ("sample_format", pa.int32()), ("compression", pa.int32()), ("predictor", pa.int32()), ("tiled", pa.bool_()), ("segments", pa.int32()), ("pixels", pa.binary()), ("error", pa.string())]
_PAGE_DDL = "struct<index:int,width:bigint,height:bigint,samples:int,bits:int,sample_format:int,compression:int,predictor:int,tiled:boolean,segments:int,pixels:binary,error:string,feature:string>"
PAGE_BYTES = 16 << 20  # pixels of a batch of pages that a task holds, and one page more


def _columns_but(df: DataFrame, names: list[str]) -> list[str]:
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


def _with_pages(df: DataFrame, source: str, keep: list[str], out: str, file_of: Callable[[object], bytes], media: str | None) -> DataFrame:
    """A row for each page of the file that file_of makes of each value of the column source: keep, the file itself under the name media if one is given, and the struct out."""
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), *([f"`{media}` binary"] if media else []), f"`{out}` {_PAGE_DDL}"])
    names = [*keep, *([media] if media else []), out]

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(kept: pa.RecordBatch, of: list[int], files: list[bytes], found: list[Page], features: list[str | None]) -> pa.RecordBatch:
            taken = kept.take(pa.array(of, pa.int64()))
            fields = [pa.array([getattr(p, n) for p in found], t) for n, t in _PAGE]
            made = pa.StructArray.from_arrays([*fields, pa.array(features, pa.string())], names=[*(n for n, _ in _PAGE), "feature"])
            return pa.RecordBatch.from_arrays([*taken.columns, *([pa.array(files, pa.binary())] if media else []), made], names=names)

        for batch in batches:
            values, kept = batch.column(batch.num_columns - 1), batch.select(list(range(len(keep))))
            of, files, found, features, held = [], [], [], [], 0
            for i in range(batch.num_rows):
                if not values[i].is_valid:
                    continue
                content = file_of(values[i].as_py())
                for page in read_pages(content):
                    of.append(i)
                    files.append(content)
                    found.append(page)
                    features.append(page_feature(page))
                    held += len(page.pixels or b"") + (len(content) if media else 0)
                    if held > PAGE_BYTES:
                        yield rows(kept, of, files, found, features)
                        of, files, found, features, held = [], [], [], [], 0
            yield rows(kept, of, files, found, features)

    return df.select(*keep, F.col(source).alias("\u0001source")).mapInArrow(pages, schema)


def tiff_pages(df: DataFrame, content: str = "content", keep: list[str] | None = None, out: str = "page") -> DataFrame:
    """One row for each page of each file in df's binary column: the columns of keep and the struct out.

    Pixels are little-endian samples, row by row, samples of a pixel together; feature is
    page_feature of them.  A null file has no rows; what is no TIFF file, or is damaged in any
    way, has a row with an error and no pixels.  keep defaults to all other columns; a column
    with the name out, in any case, is replaced.  Repeated rows repeat.
    """
    keep = _columns_but(df.select(*keep) if keep is not None else df, [out, *([content] if keep is None else [])])
    return _with_pages(df, content, keep, out, lambda file: file, None)


def payload_page(payload: bytes) -> bytes:
    """Stores bytes, a positive multiple of 64 of them, as one page of 8-bit samples 64 wide; the checksum picks the layout."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    layouts = (Layout(PACKBITS, strip_rows=128), Layout(LZW, tile=(32, 64)), Layout(DEFLATE, predictor=2, strip_rows=512))
    return write_tiff([(image, layouts[zlib.crc32(payload) % 3])])


def text_file(text: str) -> bytes:
    """A text's bytes, padded by zeros to a positive multiple of 64, as a TIFF file."""
    raw = text.encode("utf-8", "surrogatepass")
    return payload_page(raw + b"\0" * (64 if not raw else -len(raw) % 64))


def stored_pages(df: DataFrame, text: str = "text", media: str = "content", out: str = "page") -> DataFrame:
    """df with each whole text (null: empty) as the TIFF file media, and a row for each page read back from that file: see tiff_pages.

    A text is written and read in one task, so neither its file nor its pixels pass through
    another worker.  Columns of df with the names media and out are replaced.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keep = _columns_but(df, [media, out])
    return _with_pages(df.select(*keep, whole.alias("\u0001text")), "\u0001text", keep, out, text_file, media)


def page_feature(page: Page) -> str | None:
    """Mean, deviation, distinct values, entropy and mean step between neighbours of a page's bytes, as text; none without pixels."""
    if page.pixels is None:
        return None
    values = np.frombuffer(page.pixels, np.uint8)
    counts = np.bincount(values, minlength=256)
    share = counts[counts > 0] / max(1, len(values))
    mean = float(share @ np.flatnonzero(counts)) if len(values) else 0.0
    spread = float(np.sqrt(share @ (np.flatnonzero(counts) - mean) ** 2)) if len(values) else 0.0
    step = float(np.abs(np.diff(values.astype(np.int16))).mean()) if len(values) > 1 else 0.0
    return f"mean={mean:.4f};std={spread:.4f};distinct={len(share)};entropy={max(0.0, float(-(share @ np.log2(share)))):.4f};step={step:.4f}"
