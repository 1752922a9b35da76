"""The four commands as Spark jobs (C01-C06, C09-C13, C20, K07, K08, K12, M18-M20): read, compare, optimize and test rasters.

Work is by file: files are spread over the tasks, and what a file's report or output needs
stays with it.  A damaged file has an error row; the others go on.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import numbers as N, text as X
from ..operators import compare as C, lookup as L, overviews as O, pixels as P, stats as S, structure as T
from ..sources import cog, ranged, tiff, tiff_format as TF
from ..sources.folders import kept

SECTIONS = ["summary", "directories", "tags", "geokeys", "statistics", "layout"]

#: Products whose values must not be mixed; the others' overviews are bilinear.
NEAREST_PRODUCTS = ("image", "thematic")

CODECS = {"NONE": TF.NONE, "LZW": TF.LZW, "DEFLATE": TF.DEFLATE, "PACKBITS": TF.PACKBITS, "ZSTD": TF.ZSTD}
LEVELS = {"DEFLATE": range(1, 10), "ZSTD": range(1, 23)}


@dataclass(frozen=True)
class Options:
    """What optimize does to a file: codec, predictor, rounding, nodata remap, tile size, overviews."""

    algorithm: str = "DEFLATE"
    predictor: int | None = None
    decimals: int | None = None
    nodata_from: float | None = None
    nodata_to: float | None = None
    tile: int = 512
    overviews: bool = True
    level: int | None = None
    resampling: str = "nearest"  # of overviews
    bands: int | None = None  # what a file must have

    def resolved(self, product: str) -> Options:
        """Defaults of a product where nothing was asked for."""
        predictor = {"dem": 2, "scientific": 3, "error": 2, "image": 2}.get(product, 1)
        decimals = {"dem": 2, "error": 1, "scientific": 8}.get(product)
        plain = self.algorithm in ("NONE", "PACKBITS")
        return replace(
            self,
            predictor=1 if plain else self.predictor or predictor,
            decimals=self.decimals if self.decimals is not None else decimals,
            resampling="nearest" if product in NEAREST_PRODUCTS else "bilinear",
            bands=1 if product in ("dem", "error") else self.bands,
        )

    def problems(self, product: str, bands: int = 1) -> list[str]:
        """what keeps the options from being used."""
        found = []
        if self.algorithm not in CODECS:
            found.append(f"algorithm {self.algorithm} isn't available")
        if self.level is not None and self.level not in LEVELS.get(self.algorithm, ()):
            found.append(f"{self.algorithm} has no level {self.level}")
        if product not in ("dem", "image", "error", "scientific", "thematic"):
            found.append(f"unknown product {product}")
        if product in ("dem", "error") and bands != 1:
            found.append(f"{product} rasters have one band")
        if self.tile % 16:
            found.append("tiles are multiples of 16")
        return found


# --- read -------------------------------------------------------------------------------


def read_sections(spark: SparkSession, path: str, sections: list[str] | None = None) -> DataFrame:
    """(path, ord, section, line_no, line) of the Markdown report; only the sections asked for are computed."""
    asked = sections or SECTIONS
    if unknown := [s for s in asked if s not in SECTIONS]:
        raise ValueError(f"unknown sections: {', '.join(sorted(unknown))}; there are {', '.join(sorted(SECTIONS))}")
    content = tiff.files(spark, path)
    build = {"summary": _summary, "directories": _directories, "tags": _tags, "geokeys": _geokeys, "statistics": _statistics, "layout": _layout}
    parts = []
    for ord_, name in enumerate(asked):
        rows, header = build[name](spark, path, content)
        cells = [c for c in rows.columns if c not in ("path", "line_no")]
        parts.append(rows.select("path", F.lit(ord_).alias("ord"), F.lit(name).alias("section"), "line_no", X.markdown_row(*[F.col(c) for c in cells]).alias("line")))
        rule = "| " + " | ".join("---" for _ in header) + " |"
        heads = content.select("path", F.lit(ord_).alias("ord"), F.lit(name).alias("section"), F.posexplode(F.array(F.lit(f"## {name.title()}"), F.lit(""), F.lit("| " + " | ".join(header) + " |"), F.lit(rule))).alias("n", "line"))
        parts.append(heads.select("path", "ord", "section", (F.col("n") - 10).cast("long").alias("line_no"), "line"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def markdown_reports(spark: SparkSession, path: str, sections: list[str] | None = None) -> DataFrame:
    """(path, report): a file's whole report as one text."""
    lines = read_sections(spark, path, sections)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", "line_no", "line"))), lambda x: x["line"])
    return lines.groupBy("path").agg(F.array_join(ordered, "\n").alias("report"))


STYLE = "body{font-family:sans-serif}table{border-collapse:collapse}td,th{border:1px solid #999;padding:2px 6px}"


def html_reports(spark: SparkSession, path: str, sections: list[str] | None = None) -> DataFrame:
    """(path, html): the same report as a page with a table for each section and links to them; no scripts or themes."""
    lines = read_sections(spark, path, sections).where("line_no >= 0 or line_no = -8")
    cells = lambda line, tag: F.concat(F.lit(f"<tr><{tag}>"), F.replace(F.regexp_replace(X.html_escaped(line), r"^\| | \|$", ""), F.lit(" | "), F.lit(f"</{tag}><{tag}>")), F.lit(f"</{tag}></tr>"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: F.when(x["line_no"] < 0, cells(x["line"], "th")).otherwise(cells(x["line"], "td")))
    tables = lines.groupBy("path", "ord", "section").agg(F.array_join(rows, "").alias("rows"))
    table = F.concat(F.lit('<h2 id="'), X.slug(F.col("section")), F.lit('">'), F.initcap("section"), F.lit("</h2><table>"), F.col("rows"), F.lit("</table>"))
    link = F.concat(F.lit('<a href="#'), X.slug(F.col("section")), F.lit('">'), F.initcap("section"), F.lit("</a>"))
    parts = F.array_sort(F.collect_list(F.struct("ord", link.alias("link"), table.alias("table"))))
    page = F.concat(F.lit(f"<!DOCTYPE html><html><head><style>{STYLE}</style></head><body><nav>"), F.array_join(F.transform(parts, lambda x: x["link"]), " "), F.lit("</nav>"), F.array_join(F.transform(parts, lambda x: x["table"]), ""), F.lit("</body></html>"))
    return tables.groupBy("path").agg(page.alias("html"))


def _summary(spark: SparkSession, path: str, content: DataFrame):
    d = tiff.ifds(content).where("ifd = 0")
    size = content.select("path", F.length("content").alias("size"))
    rows = d.join(size, "path").select("path", F.lit(0).cast("long").alias("line_no"), F.concat_ws(" x ", "width", "height").alias("pixels"), "samples", T.dtype_name(F.col("sample_format"), F.col("bits")).alias("dtype"), F.round(N.megabytes(F.col("size")), 4).alias("mb"), F.coalesce("error", F.lit("")).alias("error"))
    return rows, ["Size", "Bands", "Type", "MB", "Error"]


def _directories(spark: SparkSession, path: str, content: DataFrame):
    c = F.col
    rows = tiff.ifds(content).where("error is null").select("path", c("ifd").cast("long").alias("line_no"), "ifd", T.ifd_kind(c("ifd"), c("subfile")).alias("kind"), F.concat_ws(" x ", "width", "height").alias("size"), T.block_size(c("width"), c("height"), c("tile_w"), c("tile_h"), c("rows_per_strip")).alias("block"), L.looked_up(c("compression"), L.COMPRESSIONS).alias("codec"), "predictor", X.grouped(c("bytecount")).alias("bytes"))
    return rows, ["IFD", "Kind", "Size", "Block", "Codec", "Predictor", "Bytes"]


def _tags(spark: SparkSession, path: str, content: DataFrame):
    t = tiff.tags(content)
    rows = t.select("path", (F.col("ifd").cast("long") * 100_000 + F.col("code")).alias("line_no"), "ifd", "code", L.looked_up(F.col("code"), L.TAG_NAMES).alias("name"), F.when(F.col("n") > 8, X.shown_array(F.split("value", ", "))).otherwise(F.col("value")).alias("value"))
    return rows, ["IFD", "Code", "Name", "Value"]


def _geokeys(spark: SparkSession, path: str, content: DataFrame):
    keys = tiff.geo(content).where("directory is not null and get(directory, 3) > 0").select("path", "ifd", F.inline(L.geokeys(F.col("directory"), F.col("doubles"), F.col("ascii"))))
    rows = keys.select("path", (F.col("ifd").cast("long") * 100_000 + F.col("id")).alias("line_no"), "id", L.looked_up(F.col("id"), L.GEOKEYS).alias("name"), "value")
    return rows, ["Key", "Name", "Value"]


def _statistics(spark: SparkSession, path: str, content: DataFrame):
    s = S.band_statistics(tiff.masked_pixels(spark, path).where("ifd = 0"), "file_id", "band")
    rows = s.select(F.col("file_id").alias("path"), F.col("band").cast("long").alias("line_no"), "band", "valid_count", "nodata_count", "valid_percent", "minimum", "maximum", "mean", "std_dev", "median")
    return rows, ["Band", "Valid", "NoData", "Valid %", "Min", "Max", "Mean", "Std", "Median"]


def layout_errors(content: DataFrame) -> DataFrame:
    """C14 on files: (path, error): block order, directory order and shrinking of overviews."""
    b = tiff.blocks(content).withColumnRenamed("path", "file_id")
    order = T.block_order_errors(b, ["block"], "file_id", "ifd").select("file_id", F.concat(F.lit("block out of order in directory "), "ifd").alias("error"))
    first = T.first_offsets(b, "block", "file_id", "ifd").select("file_id", F.col("ifd").alias("level"), F.col("first_offset").alias("data_offset"))
    d = tiff.ifds(content).where("error is null").select(F.col("path").alias("file_id"), F.col("ifd").alias("level"), "width", "height", "ifd_offset")
    pyramid = T.pyramid_errors(d.join(first, ["file_id", "level"], "left")).select("file_id", F.concat(F.lit("level "), "level", F.lit(": "), "error").alias("error"))
    damaged = tiff.ifds(content).where("error is not null").select(F.col("path").alias("file_id"), "error")
    return order.unionByName(pyramid).unionByName(damaged).withColumnRenamed("file_id", "path")


def _layout(spark: SparkSession, path: str, content: DataFrame):
    rows = layout_errors(content).distinct().select("path", F.lit(0).cast("long").alias("line_no"), "error")
    return rows, ["Error"]


# --- compare ----------------------------------------------------------------------------


def compare_files(spark: SparkSession, base: str, comp: str) -> DataFrame:
    """Files at equal places below two folders: sizes, savings and the verdict."""

    def side(path: str, role: str) -> DataFrame:
        name = F.substring_index("path", path.rstrip("/") + "/", -1)  # the place below the folder
        content = tiff.files(spark, path)
        saved = T.compression_efficiency(tiff.ifds(content).where("error is null").select("path", "width", "height", "bits", F.col("samples").alias("bands"), "compression", "bytecount"), "path")
        sizes = content.select("path", F.length("content").cast("long").alias("size"))
        return sizes.join(saved, "path").select(name.alias("file"), F.lit(role).alias("role"), "size", "efficiency")

    d = C.difference(side(base, "base").unionByName(side(comp, "comp")), "file")
    return d.withColumn("verdict", C.verdict(F.col("delta"), F.col("percent"), F.col("eff_delta")))


# --- optimize and test ------------------------------------------------------------------


def prepared(data: Column, options: Options) -> Column:
    """Nodata remap, then rounding, over a row of samples; JVM expressions, no shuffle."""

    def one(v: Column) -> Column:
        if options.nodata_from is not None and options.nodata_to is not None:
            v = P.remapped(v, options.nodata_from, options.nodata_to)
        return P.rounded(v, options.decimals) if options.decimals is not None else v

    return F.transform(data, one)


def build_file(rows: pd.DataFrame, options: Options, dtype: str) -> bytes:
    """A file from (band, row, data): the image and, if asked, overviews by nearest neighbour."""
    bands = [np.stack(g.sort_values("row")["data"].to_list()) for _, g in rows.groupby("band")]
    image = np.stack(bands, axis=2).astype(dtype)
    predictor = options.predictor or 1
    if predictor == 3 and image.dtype.kind != "f" or predictor == 2 and image.dtype.kind == "f":
        predictor = 1 if predictor == 3 else 3
    layout = TF.Layout(CODECS[options.algorithm], predictor, (options.tile, options.tile), level=options.level)
    pages = [(image, layout)]
    factor = 2
    while options.overviews and max(image.shape[:2]) / factor > options.tile / 2:
        pages.append((np.ascontiguousarray(image[::factor, ::factor]), replace(layout, extra={254: ("I", (1,))})))
        factor *= 2
    return TF.write_tiff(pages)


def optimized(rows: DataFrame, options: Options, dtype: str = "<f4") -> DataFrame:
    """(path, content, error) of each file of rows (path, band, row, data).

    A file's rows meet in one task, since a file is one stream; files are independent.
    """
    ready = rows.select("path", "band", "row", prepared(F.col("data"), options).alias("data"))

    def write(group: pd.DataFrame) -> pd.DataFrame:
        path = group["path"].iloc[0]
        try:
            return pd.DataFrame([(path, build_file(group, options, dtype), None)], columns=["path", "content", "error"])
        except Exception as e:  # one file's failure is its row
            return pd.DataFrame([(path, None, f"{type(e).__name__}: {e}")], columns=["path", "content", "error"])

    return ready.groupBy("path").applyInPandas(write, "path string, content binary, error string")


#: Tags that a rewritten file keeps, with their kinds: description, software, date, extra samples, georeference, metadata, nodata.
CARRIED = {270: "s", 305: "s", 306: "s", 338: "H", 33550: "d", 33922: "d", 34735: "H", 34736: "d", 34737: "s", 42112: "s", 42113: "s", 50909: "s"}


def carried_tags(tags: dict[int, tuple], nodata_to: float | None = None) -> dict[int, tuple]:
    """The kept tags of a directory as the writer takes them; a new nodata value replaces the old."""
    kept = {code: (kind, b"".join(tags[code]) if kind == "s" else tags[code]) for code, kind in CARRIED.items() if tags.get(code) and (kind != "s" or isinstance(tags[code][0], bytes))}
    if tags.get(TF.PHOTOMETRIC):
        kept[TF.PHOTOMETRIC] = ("H", (tags[TF.PHOTOMETRIC][0],))
    if nodata_to is not None:
        kept[42113] = ("s", f"{nodata_to:g}".encode() + b"\0")
    return kept


def smaller(image: np.ndarray, nodata: float | None, resampling: str) -> np.ndarray:
    """An overview of half the size (rounded up), in the image's type; nodata has no weight in bilinear means."""
    if resampling == "nearest":
        return np.ascontiguousarray(image[::2, ::2])
    h, w = image.shape[:2]
    bands = []
    for band in np.moveaxis(image.astype(np.float64), 2, 0):
        canvas = np.full((h + h % 2 + 2, w + w % 2 + 2), np.nan)
        canvas[1 : h + 1, 1 : w + 1] = band if nodata is None else np.where(band == nodata, np.nan, band)
        bands.append(O.halved(canvas, resampling))
    out = np.stack(bands, axis=2)
    if image.dtype.kind != "f":
        return np.rint(np.where(np.isnan(out), 0 if nodata is None else nodata, out)).astype(image.dtype)
    return (out if nodata is None else np.where(np.isnan(out), nodata, out)).astype(image.dtype)


def rewrite(data: bytes, options: Options) -> bytes:
    """A file's first image, in its own sample type and with its tags and mask, under the options."""
    dirs = list(TF.directories(data))
    image = TF.page_image(TF.read_page(data, dirs[0], 0))
    kind = image.dtype.kind
    out = image.astype(image.dtype.newbyteorder("="))
    if options.nodata_from is not None and options.nodata_to is not None:
        same = np.isnan(out) if kind == "f" and options.nodata_from != options.nodata_from else out == options.nodata_from
        if kind != "f" and not (np.iinfo(out.dtype).min <= options.nodata_to <= np.iinfo(out.dtype).max and options.nodata_to == int(options.nodata_to)):
            raise ValueError(f"{out.dtype} has no value {options.nodata_to}")
        out = np.where(same, out.dtype.type(options.nodata_to), out)
    if options.decimals is not None and kind == "f":
        out = (np.rint(out.astype(np.float64) * 10.0**options.decimals) / 10.0**options.decimals).astype(out.dtype)
    predictor = {("f", 2): 3, ("u", 3): 2, ("i", 3): 2}.get((kind, options.predictor or 1), options.predictor or 1)
    layout = TF.Layout(CODECS[options.algorithm], predictor, (options.tile, options.tile), level=options.level)
    if options.bands not in (None, image.shape[2]):
        raise ValueError(f"{image.shape[2]} bands instead of {options.bands}")
    pages = [(out, replace(layout, extra=carried_tags(dirs[0], options.nodata_to)))]
    flat = replace(layout, predictor=1)
    hidden = None
    mask = next((m for m in dirs[1:] if TF.is_mask(m) and (m[TF.HEIGHT][0], m[TF.WIDTH][0]) == image.shape[:2]), None)
    if mask is not None:
        hidden = np.where(TF.page_image(TF.read_page(data, mask, 0)) > 0, 255, 0).astype(np.uint8)
        pages.append((hidden, replace(flat, extra={254: ("I", (4,)), TF.PHOTOMETRIC: ("H", (4,))})))
    nodata = ranged.nodata_of(dirs[0]) if options.nodata_to is None else options.nodata_to
    factor = 2
    while options.overviews and max(image.shape[:2]) / factor > options.tile / 2:
        out = smaller(out, nodata, options.resampling)
        pages.append((out, replace(layout, extra={254: ("I", (1,))})))
        if hidden is not None:
            hidden = np.ascontiguousarray(hidden[::2, ::2])
            pages.append((hidden, replace(flat, extra={254: ("I", (5,)), TF.PHOTOMETRIC: ("H", (4,))})))
        factor *= 2
    return TF.write_tiff(pages)


def rewritten(content: DataFrame, options: Options) -> DataFrame:
    """(path, content, error) of files (path, content); each file stays in its task, nothing is shuffled, a file that can't be read has its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0  # many small files share a batch, a large one has its own

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), (pa.string(), pa.binary(), pa.string()), strict=True)], names=["path", "content", "error"])

        for batch in batches:
            for path, data in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    done = (path.as_py(), rewrite(bytes(data.as_py()), options), None)
                except (*TF.DAMAGE, NotImplementedError, AttributeError) as e:
                    done = (path.as_py(), None, f"{type(e).__name__}: {e}")
                held.append(done)
                size += len(done[1] or b"")
                if len(held) >= tiff.BATCH_ROWS or size >= tiff.BATCH_BYTES:
                    yield made()
                    held, size = [], 0
        if held:
            yield made()

    return content.select(F.col("path").cast("string").alias("path"), "content").mapInArrow(run, "path string, content binary, error string")


def stored(files: DataFrame, folder: str, base: str = "") -> DataFrame:
    """Writes (path, content, error) into folder, at each path's place below base; returns (path, target, size, error).

    Files of equal names in different folders stay apart; a row with an error writes nothing.
    """
    from pyarrow import fs

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            out = []
            for path, content, error in zip(batch["path"], batch["content"], batch["error"], strict=True):
                below = path.split(base.rstrip("/") + "/", 1)[-1] if base and base.rstrip("/") + "/" in path else path.rsplit("/", 1)[-1]
                target = f"{root}/{below}"
                if content is None:
                    out.append((path, None, None, error))
                    continue
                where.create_dir(target.rsplit("/", 1)[0], recursive=True)
                part = f"{target}.{uuid.uuid4().hex}.part"  # each attempt of a task has its own
                try:
                    with where.open_output_stream(part) as f:
                        f.write(content)
                    where.move(part, target)
                except BaseException:
                    where.delete_file(part)
                    raise
                out.append((path, target, len(content), None))
            yield pd.DataFrame(out, columns=["path", "target", "size", "error"]).astype({"size": "Int64"})

    return files.select("path", "content", "error").mapInPandas(write, "path string, target string, size long, error string")


def optimize(spark: SparkSession, path: str, folder: str, product: str = "dem", options: Options | None = None) -> DataFrame:
    """The optimize command over a folder tree: (path, target, size, error) of every file, written to the same place below another folder."""
    chosen = (options or Options()).resolved(product)
    if problems := chosen.problems(product):
        raise ValueError("; ".join(problems))
    return stored(rewritten(tiff.files(spark, path), chosen), folder, path)


def optimize_cog(spark: SparkSession, path: str, folder: str, product: str = "dem", options: Options | None = None) -> DataFrame:
    """The optimize command with cloud-optimised output: (path, target, size, error) of every file.

    Files are read by ranges, remapped and rounded as rows of samples (prepared), dealt out by block, and
    written by block (see sources.cog), so no task has a file whole.  Overviews are made of the
    prepared samples: nearest for images and thematic rasters, else bilinear.  Type,
    georeference, metadata and nodata are kept.  Files with a mask or an alpha sample, damaged
    ones and those that the product doesn't allow have an error; optimize keeps masks.
    """
    chosen = (options or Options()).resolved(product)
    if problems := chosen.problems(product):
        raise ValueError("; ".join(problems))
    ranged.register(spark)
    read = lambda table: spark.read.format("tiff").option("path", path).option("table", table)
    dirs = read("directories").load()
    whole = dirs.groupBy("path").agg(F.max("error").alias("error"), F.count_if((F.col("ifd") > 0) & (F.col("subfile").bitwiseAND(F.lit(4)) != 0)).alias("masks"))
    first = dirs.where("ifd = 0").select("path", "width", "height", "samples", "nodata", "alpha", T.dtype_name(F.col("sample_format"), F.col("bits")).alias("dtype"), "bits", "sample_format")
    files = whole.join(first, "path", "left")
    alone = F.col("samples") == 1 if product in ("dem", "error") else F.lit(True)
    error = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("width").isNull(), "no directory").when(F.col("masks") > 0, "has a mask").when(F.col("alpha"), "has an alpha sample").when(~alone, f"{product} rasters have one band")
    files = kept(files.withColumn("error", error), "files")
    pixels = read("pixels").option("ifd", 0).load()
    broken = pixels.where("error is not null").groupBy("path").agg(F.max("error").alias("broken"))
    files = kept(files.join(broken, "path", "left").withColumn("error", F.coalesce("error", "broken")).drop("broken"), "files")
    good = files.where("error is null")
    below = lambda p: p.split(path.split("://", 1)[-1].rstrip("/") + "/", 1)[-1]
    tags = lambda p: carried_tags(next(TF.directories(ranged.Ranged(p))), chosen.nodata_to)
    done = files.where("error is not null").select("path", F.lit(None).cast("string").alias("target"), F.lit(None).cast("long").alias("size"), "error")
    segments = pixels.where("error is null").select("path", "band", "row", "col", prepared(F.col("data"), chosen).alias("data"))
    for kind in good.select("sample_format", "bits").distinct().collect():  # some ten at most
        dtype = f"<{ {1: 'u', 2: 'i', 3: 'f'}[kind.sample_format]}{kind.bits // 8}"
        mine = good.where((F.col("sample_format") == kind.sample_format) & (F.col("bits") == kind.bits))
        predictor = {("f", 2): 3, ("u", 3): 2, ("i", 3): 2}.get((dtype[1], chosen.predictor or 1), chosen.predictor or 1)
        for nodata in mine.select(F.coalesce(F.lit(chosen.nodata_to).cast("double"), "nodata").alias("nodata")).distinct().collect():
            same = mine.where(F.coalesce(F.lit(chosen.nodata_to).cast("double"), "nodata").eqNullSafe(F.lit(nodata.nodata)))
            form = cog.Form(dtype, CODECS[chosen.algorithm], predictor, chosen.level, chosen.tile, nodata.nodata)
            blocks = O.blocks_of(segments.join(same.select("path"), "path", "left_semi"), same, chosen.tile, same.select("path", F.lit(nodata.nodata).cast("double").alias("nodata")))
            blocks = O.pyramid(blocks, chosen.tile, "nearest" if product in NEAREST_PRODUCTS else "bilinear") if chosen.overviews else blocks
            done = done.unionByName(cog.written(blocks, folder, form, below, tags))
    return done


MOST_TRIALS = 10_000  # rows of a parameter grid; a longer one is refused, never cut


def read_grid(spark: SparkSession, path: str) -> list[dict]:
    """A parameter grid from CSV; its header must name the type and the algorithm, and it must have rows."""
    grid = spark.read.csv(path, header=True)
    if missing := {"type", "algorithm"} - set(grid.columns):
        raise ValueError(f"the grid lacks {', '.join(sorted(missing))}")
    rows = [r.asDict() for r in grid.limit(MOST_TRIALS + 1).collect()]  # a grid is a page of options
    if len(rows) > MOST_TRIALS:
        raise ValueError(f"the grid has more than {MOST_TRIALS} rows")
    if not rows:
        raise ValueError("the grid is empty")
    return rows


def tested(rows: DataFrame, grid: list[Options], dtype: str = "<f4") -> DataFrame:
    """(file_id, trial, algorithm, predictor, size, saved) of every file under the baseline (trial 0, stored plain) and each row of the grid."""
    every = [Options(algorithm="NONE", predictor=1, overviews=False), *grid]
    sized = None
    for trial, options in enumerate(every):
        part = optimized(rows, options, dtype).select(F.col("path").alias("file_id"), F.lit(trial).alias("trial"), F.lit(options.algorithm).alias("algorithm"), F.lit(options.predictor).cast("int").alias("predictor"), F.length("content").cast("long").alias("size"))
        sized = part if sized is None else sized.unionByName(part)
    ratios = C.trial_ratios(sized.withColumn("seconds", F.lit(0.0)))
    return sized.join(ratios.select("file_id", "trial", "saved"), ["file_id", "trial"])
