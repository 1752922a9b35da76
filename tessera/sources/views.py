"""Raster-shaped views over the driver's tables (our invention, for tests and benchmarks)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

BANDS = [("quantity", "l_quantity"), ("price", "l_extendedprice"), ("discount", "l_discount"), ("tax", "l_tax")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, band, band_name, value, is_nodata, is_masked, is_alpha0): four Float64 bands; a supplier is a file."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("file_id"),
        (F.col("l_quantity") == 1).alias("is_nodata"),
        (F.col("l_returnflag") == "R").alias("is_masked"),
        (F.col("l_linestatus") == "O").alias("is_alpha0"),
        F.explode(F.array(*[F.struct(F.lit(i).alias("band"), F.lit(n).alias("band_name"), F.col(c).alias("value")) for i, (n, c) in enumerate(BANDS, 1)])).alias("p"),
    )
    return rows.select("file_id", "p.band", "p.band_name", "p.value", "is_nodata", "is_masked", "is_alpha0")


PIXELS_SQL = "px AS (" + " UNION ALL ".join(f"SELECT l_suppkey AS file_id, {i} AS band, '{n}' AS band_name, {c} AS value, l_quantity = 1 AS is_nodata, l_returnflag = 'R' AS is_masked, l_linestatus = 'O' AS is_alpha0 FROM lineitem" for i, (n, c) in enumerate(BANDS, 1)) + ")"


def tile_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tx, band, row, col, value, label): every embedding is an 8 x 8 Float32 tile of one of four bands."""
    return table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 4).alias("tx"), (F.col("vec_id") % 4 + 1).cast("int").alias("band"), "label", F.posexplode("embedding").alias("i", "value")
    ).select("tx", "band", F.floor(F.col("i") / 8).cast("int").alias("row"), (F.col("i") % 8).alias("col"), F.col("value").cast("double").alias("value"), "label")


TILE_PIXELS_SQL = "tp AS (SELECT vec_id // 4 AS tx, CAST(vec_id % 4 + 1 AS INT) AS band, label, CAST((i - 1) // 8 AS INT) AS row, CAST((i - 1) % 8 AS INT) AS col, CAST(embedding[i] AS DOUBLE) AS value FROM embeddings, (SELECT unnest(generate_series(1, 64)) AS i))"


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, block, bytecount, offset): a user's events as the blocks of a file; every fifth offset is too small."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts")
    sized = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.floor(F.col("value") * 100).cast("long").alias("bytecount"))
    placed = sized.select("user_id", "event_id", (F.row_number().over(order) - 1).alias("block"), "bytecount", (F.sum("bytecount").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("bytecount")).alias("place"))
    return placed.select(F.col("user_id").alias("file_id"), "block", "bytecount", F.when(F.col("event_id") % 5 == 0, F.greatest(F.col("place") - 20_000, F.lit(0))).otherwise(F.col("place")).alias("offset"))


BLOCKS_SQL = """sized AS (SELECT user_id, event_id, ts, CAST(floor(value * 100) AS BIGINT) AS bytecount FROM events),
placed AS (SELECT user_id AS file_id, event_id, CAST(row_number() OVER w - 1 AS INT) AS block, bytecount,
  CAST(sum(bytecount) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) - bytecount AS place
  FROM sized WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
blocks AS (SELECT file_id, block, bytecount, CASE WHEN event_id % 5 = 0 THEN greatest(place - 20000, 0) ELSE place END AS "offset" FROM placed)"""


def ifds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as image directories: (file_id, ifd, width, height, bits, bands, compression, subfile, tile_w, tile_h, rows_per_strip, sample_format, predictor, bytecount)."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").alias("file_id"),
        F.col("o_orderkey").alias("ifd"),
        (F.col("o_orderkey") % 997 + 1).cast("int").alias("width"),
        (F.col("o_custkey") % 499 + 1).cast("int").alias("height"),
        F.element_at(F.array(*[F.lit(x) for x in (8, 16, 32, 64)]), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("bits"),
        (F.col("o_orderkey") % 3 + 1).cast("int").alias("bands"),
        F.element_at(F.array(*[F.lit(x) for x in (1, 5, 8, 50000, 7)]), (F.col("o_custkey") % 5 + 1).cast("int")).alias("compression"),
        (F.col("o_orderkey") % 8).cast("int").alias("subfile"),
        F.when(F.col("o_orderkey") % 2 == 0, 256).alias("tile_w"),
        F.when(F.col("o_orderkey") % 2 == 0, 128).alias("tile_h"),
        F.when(F.col("o_orderkey") % 3 == 0, F.lit(None)).otherwise(F.col("o_orderkey") % 700).cast("int").alias("rows_per_strip"),
        (F.col("o_orderkey") % 7).cast("int").alias("sample_format"),
        (F.col("o_custkey") % 4).cast("int").alias("predictor"),
        F.floor(F.col("o_totalprice")).cast("long").alias("bytecount"),
    )


IFDS_SQL = """ifds AS (SELECT o_custkey AS file_id, o_orderkey AS ifd, CAST(o_orderkey % 997 + 1 AS INT) AS width, CAST(o_custkey % 499 + 1 AS INT) AS height,
  [8, 16, 32, 64][o_orderkey % 4 + 1] AS bits, CAST(o_orderkey % 3 + 1 AS INT) AS bands, [1, 5, 8, 50000, 7][o_custkey % 5 + 1] AS compression,
  CAST(o_orderkey % 8 AS INT) AS subfile, CASE WHEN o_orderkey % 2 = 0 THEN 256 END AS tile_w, CASE WHEN o_orderkey % 2 = 0 THEN 128 END AS tile_h,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 700 AS INT) END AS rows_per_strip, CAST(o_orderkey % 7 AS INT) AS sample_format,
  CAST(o_custkey % 4 AS INT) AS predictor, CAST(floor(o_totalprice) AS BIGINT) AS bytecount FROM orders)"""
