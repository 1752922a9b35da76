"""Queries that write rasters as TIFF files and read them back, and the codec benchmark."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import structure as T
from ..sources import tiff, tiff_format as TF, views as V
from ..sources.folders import kept


def _files(spark: SparkSession, sf_dir: str, layout: TF.Layout) -> DataFrame:
    e = V.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("path"), "embedding")
    return tiff.encoded(e, 8, "embedding", layout=layout)


def tiff_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 x 8 Float32 files, deflated with the floating-point predictor, and their statistics from the files."""
    content = _files(spark, sf_dir, TF.Layout(TF.DEFLATE, predictor=3, strip_rows=4))
    long = tiff.pixels(content).select("path", F.explode("data").alias("v"))
    return long.groupBy(F.col("path").cast("long").alias("vec_id")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.round(F.sum(F.col("v").cast("decimal(28,9)")).cast("double"), 6).alias("total"))


def tiff_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories of the files, with their block counts."""
    content = kept(_files(spark, sf_dir, TF.Layout(TF.LZW, tile=(16, 16))), "content")
    d = tiff.ifds(content).select(F.col("path").cast("long").alias("vec_id"), "width", "height", T.dtype_name(F.col("sample_format"), F.col("bits")).alias("dtype"), "compression", T.block_size(F.col("width"), F.col("height"), F.col("tile_w"), F.col("tile_h"), F.col("rows_per_strip")).alias("block"))
    n = tiff.tags(content).where("code = 324").select(F.col("path").cast("long").alias("vec_id"), F.col("n").alias("blocks"))
    return d.join(n, "vec_id")


def codec_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored bytes of every tile under each codec and predictor, added up; sizes are exact, so no times are given."""
    grid = [(c, p) for c in ("NONE", "LZW", "DEFLATE", "PACKBITS", "ZSTD") for p in (1, 3)]

    @F.pandas_udf("array<long>")
    def sizes(column: pd.Series) -> pd.Series:
        codes = {"NONE": TF.NONE, "LZW": TF.LZW, "DEFLATE": TF.DEFLATE, "PACKBITS": TF.PACKBITS, "ZSTD": TF.ZSTD}
        return pd.Series([[len(TF.encode_segment(np.asarray(x, "<f4").reshape(8, 8, 1), TF.Layout(codes[c], p))) for c, p in grid] for x in column])

    e = V.table(spark, sf_dir, "embeddings").select(F.posexplode(sizes("embedding")).alias("trial", "size"))
    names = F.array(*[F.lit(f"{c} predictor {p}") for c, p in grid])
    return e.groupBy("trial").agg(F.sum("size").alias("size")).select(F.get(names, F.col("trial")).alias("codec"), "size")


def deflate_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A09 with real codecs: documents as directories, their texts deflated; efficiency by source."""

    @F.pandas_udf("long")
    def deflated(texts: pd.Series) -> pd.Series:
        return pd.Series([len(zlib.compress((t or "").encode("utf-8", "surrogatepass"), 6)) for t in texts], dtype="int64")

    d = V.table(spark, sf_dir, "documents").select("source", F.octet_length(F.coalesce("text", F.lit(""))).alias("width"), F.lit(1).alias("height"), F.lit(8).alias("bits"), F.lit(1).alias("bands"), F.lit(8).alias("compression"), deflated("text").alias("bytecount"))
    return T.compression_efficiency(d, "source")


QUERIES = {
    "k01_tiff_roundtrip": (tiff_roundtrip, "WITH e AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) SELECT vec_id, count(*) AS n, min(v) AS lo, max(v) AS hi, round(CAST(sum(CAST(v AS DECIMAL(28,9))) AS DOUBLE), 6) AS total FROM e GROUP BY vec_id"),
    "s05_tiff_directories": (tiff_directories, "SELECT vec_id, CAST(8 AS BIGINT) AS width, CAST(8 AS BIGINT) AS height, 'Float32' AS dtype, 5 AS compression, '16 x 16' AS block, 1 AS blocks FROM embeddings"),
    "c09_codec_benchmark": (codec_benchmark, None),
    "a09_deflate_efficiency": (deflate_sizes, None),
}
