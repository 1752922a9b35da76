"""Queries over cloud-optimised files: a mosaic of all embeddings is written by blocks and read back by ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import overviews as O
from ..sources import cog, ranged, tiff_format as TF, views as V
from ..sources.folders import new_path

TILE, ACROSS, NODATA = 16, 8, -9999.0


def mosaic(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Segments and sizes of one image of four bands: embeddings are 8 x 8 samples, ACROSS of them beside each other; what is left of the last row has no value."""
    e = V.table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 4 + 1).cast("int").alias("band"), F.floor(F.col("vec_id") / 4).alias("k"), F.col("embedding").cast("array<double>").alias("e"))
    rows = e.select("band", "k", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("e", i * 8 + 1, 8))).alias("i", "data"))
    top, left = F.floor(F.col("k") / ACROSS) * 8, F.col("k") % ACROSS * 8
    segments = rows.select(F.lit("mosaic.tif").alias("path"), "band", (top + F.col("i")).cast("int").alias("row"), left.cast("int").alias("col"), "data")
    sizes = e.groupBy().agg(F.lit("mosaic.tif").alias("path"), F.lit(8 * ACROSS).alias("width"), ((F.floor(F.max("k") / ACROSS) + 1) * 8).alias("height"))
    return segments, sizes


def written_mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiff source over the mosaic's file, written with all levels."""
    segments, sizes = mosaic(spark, sf_dir)
    blocks = O.pyramid(O.blocks_of(segments, sizes, TILE), TILE, "bilinear")
    folder = new_path(spark, "mosaic")
    errors = cog.written(blocks, folder, cog.Form("<f8", TF.ZSTD, 3, tile=TILE, nodata=NODATA)).where("error is not null").collect()
    if errors:
        raise ValueError(errors[0].error)
    ranged.register(spark)
    return spark.read.format("tiff").option("path", folder)


def cog_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every level of the file: samples with a value, and their sum."""
    px = written_mosaic(spark, sf_dir).load().where("error is null").select(F.col("ifd").alias("level"), "band", "row", F.filter("data", lambda v: v != NODATA).alias("v")).where(F.size("v") > 0)
    total = F.sum(F.aggregate("v", F.lit(0.0), lambda a, x: a + x))
    return px.groupBy("level", "band", "row").agg(F.sum(F.size("v")).cast("long").alias("n"), F.round(total, 6).alias("total"))


def row_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 64th row of the first directory and of one band; only blocks with such a row are fetched."""
    px = written_mosaic(spark, sf_dir).option("row_step", 64).load().where("ifd = 0 and band = 2")
    px = px.select("row", "block", F.filter("data", lambda v: v != NODATA).alias("v")).where(F.size("v") > 0)
    total = F.sum(F.aggregate("v", F.lit(0.0), lambda a, x: a + x))
    return px.groupBy("row").agg(F.count_distinct("block").alias("blocks"), F.round(total, 6).alias("total"))


_MOSAIC = f"""WITH e AS (SELECT CAST(vec_id % 4 + 1 AS INT) AS band, vec_id // 4 AS k, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
l0 AS (SELECT band, k // {ACROSS} * 8 + i // 8 AS r, k % {ACROSS} * 8 + i % 8 AS c, v FROM e), s0 AS (SELECT {8 * ACROSS} AS w, (max(k) // {ACROSS} + 1) * 8 AS h FROM e),
kernel AS (SELECT unnest([0, 1, 2, 3]) AS o, unnest([0.125::DOUBLE, 0.375, 0.375, 0.125]) AS weight)"""


def _level_sql(n: int) -> str:
    """Level n + 1 from level n; empty once the level below is one block."""
    return f"""s{n + 1} AS (SELECT (w + 1) // 2 AS w, (h + 1) // 2 AS h FROM s{n} WHERE w > {TILE} OR h > {TILE}),
l{n + 1} AS (SELECT band, (r + 1 - y.o) // 2 AS r, (c + 1 - x.o) // 2 AS c, sum(v * y.weight * x.weight) / sum(y.weight * x.weight) AS v FROM l{n}, kernel y, kernel x, s{n + 1}
  WHERE (r + 1 - y.o) % 2 = 0 AND (c + 1 - x.o) % 2 = 0 AND r + 1 >= y.o AND c + 1 >= x.o AND (r + 1 - y.o) // 2 < h AND (c + 1 - x.o) // 2 < w GROUP BY 1, 2, 3)"""


_DEEP = 12  # levels of the SQL: as many as an image of 16 x 2**12 rows has
_LEVELS_SQL = (
    ",\n".join([_MOSAIC, *map(_level_sql, range(_DEEP))])
    + "\n"
    + " UNION ALL ".join(f"SELECT CAST({n} AS INT) AS level, band, CAST(r AS INT) AS row, count(*) AS n, round(sum(v), 6) AS total FROM l{n} GROUP BY band, r" for n in range(_DEEP + 1))
)

QUERIES = {
    "k01_cog_levels": (cog_levels, _LEVELS_SQL),
    "s10_row_stride": (row_stride, f"{_MOSAIC} SELECT CAST(r AS INT) AS row, count(DISTINCT c // {TILE}) AS blocks, round(sum(v), 6) AS total FROM l0 WHERE band = 2 AND r % 64 = 0 GROUP BY r"),
}
