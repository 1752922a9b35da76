"""The commands over rasters made from the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources import tiff, views as V
from . import pipelines as P


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each label and remainder: its embeddings are the image's rows, 64 wide."""
    from pyspark.sql import Window

    e = V.table(spark, sf_dir, "embeddings").withColumn("path", F.concat(F.lit("f"), "label", F.lit("_"), F.col("vec_id") % 4))
    row = F.row_number().over(Window.partitionBy("path").orderBy("vec_id")) - 1
    return e.select("path", F.lit(1).alias("band"), row.alias("row"), F.col("embedding").cast("array<double>").alias("data"))


def optimize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounded to two decimals, deflated, read back from the files' first directories."""
    files = P.optimized(_rows(spark, sf_dir), P.Options(decimals=2, predictor=3, tile=64), "<f8")
    back = tiff.pixels(files.where("error is null")).where("ifd = 0").select("path", F.explode("data").alias("v"))
    return back.groupBy("path").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.round(F.sum(F.col("v").cast("decimal(20,2)")).cast("double"), 2).alias("total"))


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every file under each codec."""
    grid = [P.Options("DEFLATE", 3, tile=64, overviews=False), P.Options("LZW", 3, tile=64, overviews=False), P.Options("DEFLATE", 1, decimals=1, tile=64, overviews=False), P.Options("ZSTD", 3, tile=64, overviews=False)]
    return P.tested(_rows(spark, sf_dir), grid)


_SQL = """WITH e AS (SELECT 'f' || label || '_' || (vec_id % 4) AS path, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), r AS (SELECT path, round_even(v * 100.0::DOUBLE, 0) / 100.0::DOUBLE AS v FROM e)
SELECT path, count(*) AS n, min(v) AS lo, max(v) AS hi, round(CAST(sum(CAST(v AS DECIMAL(20,2))) AS DOUBLE), 2) AS total FROM r GROUP BY path"""

QUERIES = {"c05_optimize": (optimize, _SQL), "c09_trials": (trials, None)}
