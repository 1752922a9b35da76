"""Queries over TIFF files made from the embeddings: masks, alpha, nodata, sample types, tags; each with its SQL twin."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import lookup as L, stats as S, structure as T
from ..sources import tiff, tiff_format as TF, views as V
from ..sources.folders import kept
from . import pipelines as P, raster_queries as R

#: Sample types that the files take in turn.
TYPES = ["<u1", "<i2", "<f4", "<f8"]
#: Tags of a georeferenced file with nodata 7, as the writer takes them.
GEO = {33550: ("d", (2.0, 2.0, 0.0)), 33922: ("d", (0.0, 0.0, 0.0, 100.0, 50.0, 0.0)), 34735: ("H", (1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, 32633)), 42113: ("s", b"7\0"), 42112: ("s", b"<GDALMetadata></GDALMetadata>\0")}


def _values(embedding: np.ndarray) -> np.ndarray:
    return np.floor(np.abs(np.asarray(embedding, np.float64)) * 100) % 256


def rgba_file(embedding: np.ndarray) -> bytes:
    """8 x 8 Byte pixels: three colours, an alpha sample that is 0 at every fourth pixel, a mask that is 0 at every eighth from 7."""
    v, at = _values(embedding), np.arange(64)
    image = np.stack([v, (v * 2) % 256, (v * 3) % 256, np.where(at % 4 == 0, 0, 255)], axis=1).reshape(8, 8, 4).astype(np.uint8)
    mask = np.where(at % 8 == 7, 0, 255).astype(np.uint8).reshape(8, 8)
    extra = {**GEO, TF.EXTRA_SAMPLES: ("H", (2,)), TF.PHOTOMETRIC: ("H", (2,))}
    return TF.write_tiff([(image, TF.Layout(TF.DEFLATE, 2, (16, 16), extra=extra)), (mask, TF.Layout(TF.PACKBITS, extra={254: ("I", (4,))}))])


def typed_file(number: int, embedding: np.ndarray) -> bytes:
    """8 x 8 samples of the file's type, with georeference, nodata and a mask; every fiftieth file is cut off."""
    image = _values(embedding).reshape(8, 8).astype(TYPES[number % 4]) // (2 if number % 4 == 0 else 1)
    mask = np.where(np.arange(64) % 8 == 7, 0, 255).astype(np.uint8).reshape(8, 8)
    data = TF.write_tiff([(image, TF.Layout(TF.LZW, extra=GEO)), (mask, TF.Layout(TF.NONE, extra={254: ("I", (4,))}))])
    return data[:40] if number % 50 == 49 else data


def _content(spark: SparkSession, sf_dir: str, make) -> DataFrame:
    @F.pandas_udf("binary")
    def files(number: pd.Series, embedding: pd.Series) -> pd.Series:
        return pd.Series([make(int(n), e) for n, e in zip(number, embedding, strict=True)], dtype=object)

    e = V.table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("path"), files("vec_id", "embedding").alias("content"))


def file_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A01, A02, U03, F01 on files: nodata by tag, the mask directory, the alpha sample."""
    px = tiff.pixel_view(_content(spark, sf_dir, lambda n, e: rgba_file(e))).where("ifd = 0")
    return S.band_statistics(px, "file_id", "band").withColumn("file_id", F.col("file_id").cast("long"))


_PIX = "e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, floor(abs(CAST(unnest(embedding) AS DOUBLE)) * 100) % 256 AS v FROM embeddings)"
_FILE_PX = f"""WITH {_PIX}, px AS (SELECT vec_id AS file_id, band, CASE band WHEN 4 THEN CASE WHEN i % 4 = 0 THEN 0 ELSE 255 END ELSE v * band % 256 END::DOUBLE AS value, i, band < 4 AND i % 4 = 0 AS is_alpha0, i % 8 = 7 AS is_masked FROM e, (SELECT CAST(unnest([1, 2, 3, 4]) AS INT) AS band)),
p AS (SELECT *, value = 7 AS is_nodata FROM px)"""


def optimized_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C05, C06, P39, K02 on files: every type is kept, and georeference, nodata, mask and metadata with it; damaged files have an error."""
    done = kept(P.rewritten(_content(spark, sf_dir, typed_file), P.Options("ZSTD", 2, tile=16, overviews=False, nodata_from=7.0, nodata_to=5.0)), "rewritten")
    good = done.where("error is null")
    d = tiff.ifds(good).where("ifd = 0").select("path", T.dtype_name(F.col("sample_format"), F.col("bits")).alias("dtype"), L.looked_up(F.col("compression"), L.COMPRESSIONS).alias("codec"))
    g = tiff.geo(good).where("ifd = 0").select("path", F.get("directory", F.lit(11)).alias("crs"), F.get("affine", F.lit(1)).alias("pixel"), "nodata")
    px = tiff.pixel_view(good).where("ifd = 0").groupBy(F.col("file_id").alias("path")).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.count_if("is_masked").alias("masked"), F.count_if("is_nodata").alias("none"))
    meta = tiff.tags(good).where("code = 42112 and ifd = 0").select("path", F.col("value").alias("metadata"))
    every = done.select("path", F.col("error").isNotNull().alias("failed"))
    for side in (d, g, px, meta):
        every = every.join(side, "path", "left")
    return every.withColumn("path", F.col("path").cast("long"))


_TYPES_SQL = f"""WITH {_PIX}, w AS (SELECT vec_id, i, CASE WHEN vec_id % 4 = 0 THEN floor(v / 2) ELSE v END AS v FROM e), p AS (SELECT vec_id, count(*) AS n, sum(CASE WHEN v = 7 THEN 5 ELSE v END)::DOUBLE AS total, count(*) FILTER (i % 8 = 7) AS masked, count(*) FILTER (v IN (5, 7)) AS none FROM w GROUP BY vec_id)
SELECT vec_id AS path, vec_id % 50 = 49 AS failed, CASE WHEN vec_id % 50 <> 49 THEN ['Byte', 'Int16', 'Float32', 'Float64'][vec_id % 4 + 1] END AS dtype, CASE WHEN vec_id % 50 <> 49 THEN 'Zstandard' END AS codec, CASE WHEN vec_id % 50 <> 49 THEN 32633 END AS crs,
CASE WHEN vec_id % 50 <> 49 THEN 2.0::DOUBLE END AS pixel, CASE WHEN vec_id % 50 <> 49 THEN 5.0::DOUBLE END AS nodata, CASE WHEN vec_id % 50 <> 49 THEN n END AS n, CASE WHEN vec_id % 50 <> 49 THEN total END AS total, CASE WHEN vec_id % 50 <> 49 THEN masked END AS masked,
CASE WHEN vec_id % 50 <> 49 THEN none END AS none, CASE WHEN vec_id % 50 <> 49 THEN '<GDALMetadata></GDALMetadata>' END AS metadata FROM p"""


def georeferenced_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Georeferenced files with transform, nodata and embedded XML."""
    content = _content(spark, sf_dir, lambda n, e: typed_file(n, e) if n % 3 else TF.write_tiff([(np.zeros((2, 2), np.uint8), TF.Layout())]))
    g = tiff.geo(content)
    xml = tiff.tags(content).where("code in (42112, 50909, 700) and ifd = 0").select("path", F.col("value").alias("xml"))
    rows = tiff.is_georeferenced(g).join(g.where("ifd = 0").select("path", F.get("affine", F.lit(0)).alias("x0"), F.get("affine", F.lit(5)).alias("dy"), "nodata"), "path").join(xml, "path", "left")
    return rows.select(F.col("path").cast("long").alias("vec_id"), "x0", "dy", "nodata", "xml")


def file_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories with their kinds and block counts, from files with a mask directory."""
    content = kept(_content(spark, sf_dir, lambda n, e: rgba_file(e)), "content")
    d = tiff.ifds(content).select("path", "ifd", T.ifd_kind(F.col("ifd"), F.col("subfile")).alias("kind"), "samples", "width", "height", "predictor", "bytecount")
    b = tiff.blocks(content).groupBy("path", "ifd").agg(F.count("*").alias("blocks"), F.sum("bytecount").alias("stored"))
    rows = d.join(b, ["path", "ifd"])
    return rows.select(F.col("path").cast("long").alias("vec_id"), "ifd", "kind", "samples", "width", "height", "predictor", "blocks", (F.col("stored") == F.col("bytecount")).alias("same_bytes"))


def error_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is damaged has rows with an error in every table."""
    content = kept(_content(spark, sf_dir, typed_file), "content")
    a = tiff.ifds(content).where("error is not null").groupBy("path").agg(F.count("*").alias("directories"))
    b = tiff.pixels(content).where("error is not null").groupBy("path").agg(F.count("*").alias("pixels"))
    return a.join(b, "path").select(F.col("path").cast("long").alias("vec_id"), "directories", "pixels")


QUERIES = {
    "a02_file_statistics": (file_statistics, _FILE_PX + f" SELECT file_id, band, {R.STATS_SQL} FROM p GROUP BY file_id, band"),
    "c06_optimized_types": (optimized_types, _TYPES_SQL),
    "s02_georeferenced_files": (georeferenced_files, "SELECT vec_id, 100.0::DOUBLE AS x0, -2.0::DOUBLE AS dy, 7.0::DOUBLE AS nodata, '<GDALMetadata></GDALMetadata>' AS xml FROM embeddings WHERE vec_id % 3 <> 0 AND vec_id % 50 <> 49"),
    "c16_file_directories": (file_blocks, "SELECT vec_id, ifd, CASE ifd WHEN 0 THEN 'Main' ELSE 'Mask' END AS kind, CASE ifd WHEN 0 THEN 4 ELSE 1 END AS samples, 8::BIGINT AS width, 8::BIGINT AS height, CASE ifd WHEN 0 THEN 2 ELSE 1 END AS predictor, 1::BIGINT AS blocks, true AS same_bytes FROM embeddings, (SELECT CAST(unnest([0, 1]) AS INT) AS ifd)"),
    "s09_error_rows": (error_rows, "SELECT vec_id, 1::BIGINT AS directories, 1::BIGINT AS pixels FROM embeddings WHERE vec_id % 50 = 49"),
}
