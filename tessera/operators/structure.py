"""Compression efficiency and layout checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

UNCOMPRESSED = 1


def plain_bytes(width: Column, height: Column, bits: Column, bands: Column) -> Column:
    """A12, X09 with one bits value for all bands."""
    return width.cast("double") * height * bits * bands / 8


def compression_efficiency(ifds: DataFrame, *keys: str) -> DataFrame:
    """Percentage saved over all directories of a file, 0 if none is compressed (Q7); bands multiply the bits (Q8)."""
    plain = F.sum(plain_bytes(F.col("width"), F.col("height"), F.col("bits"), F.col("bands")))
    saved = (1 - F.try_divide(F.sum("bytecount").cast("double"), plain)) * 100
    return ifds.groupBy(*keys).agg(plain.cast("long").alias("plain_bytes"), F.sum("bytecount").alias("stored_bytes"), F.round(F.when(F.bool_or(F.col("compression") != UNCOMPRESSED), saved).otherwise(0.0), 4).alias("efficiency"))


def ifd_savings(ifds: DataFrame) -> DataFrame:
    """Savings and ratio of each directory; one bits value is taken for all bands (Q8)."""
    plain = plain_bytes(F.col("width"), F.col("height"), F.col("bits"), F.lit(1))
    return ifds.select("file_id", "ifd", plain.cast("long").alias("plain_bytes"), F.round((1 - F.try_divide(F.col("bytecount").cast("double"), plain)) * 100, 4).alias("savings"), F.round(F.try_divide(plain, F.col("bytecount").cast("double")), 4).alias("ratio"))


def ifd_kind(ifd: Column, subfile: Column) -> Column:
    """Reduced image, page and mask bits in that order; directory 0 is the main image."""
    return F.when(ifd == 0, "Main").when(subfile.bitwiseAND(1) != 0, "Overview").when(subfile.bitwiseAND(2) != 0, "Page").when(subfile.bitwiseAND(4) != 0, "Mask").otherwise("Image")


def dtype_name(sample_format: Column, bits: Column) -> Column:
    """P11."""
    unsigned = F.when(bits == 1, "Bit").when(bits == 8, "Byte").otherwise(F.concat(F.lit("UInt"), bits))
    return F.when(sample_format == 1, unsigned).when(sample_format == 2, F.concat(F.lit("Int"), bits)).when(sample_format == 3, F.concat(F.lit("Float"), bits)).when(sample_format == 5, F.concat(F.lit("CInt"), bits)).when(sample_format == 6, F.concat(F.lit("CFloat"), bits)).otherwise("Undefined")


def block_size(width: Column, height: Column, tile_w: Column, tile_h: Column, rows: Column) -> Column:
    """The tile tags, else the strip tag kept within the image."""
    strip = F.concat_ws(" x ", width, F.greatest(F.least(F.coalesce(rows, height), height), F.lit(1)))
    return F.coalesce(F.when(tile_w.isNotNull() & tile_h.isNotNull(), F.concat_ws(" x ", tile_w, tile_h)), strip)


def block_order_errors(blocks: DataFrame, order: list[str], *keys: str) -> DataFrame:
    """Blocks with data whose offset is less than that of the block with data before them."""
    before = Window.partitionBy(*keys).orderBy(*order)
    found = blocks.where("offset > 0").withColumn("before", F.lag("offset").over(before))
    return found.where("offset < before").select(*keys, *order, "offset", "before")


def first_offsets(blocks: DataFrame, order: str, *keys: str) -> DataFrame:
    """The first and the least offset of a block with data."""
    return blocks.where("offset > 0").groupBy(*keys).agg(F.min_by("offset", order).alias("first_offset"), F.min("offset").alias("least_offset"))


def pyramid_errors(levels: DataFrame) -> DataFrame:
    """(file_id, level, error) of overviews that don't shrink, directories out of order and data before a smaller overview's."""
    by = Window.partitionBy("file_id").orderBy("level")
    seen = levels.withColumns({"w": F.lag("width").over(by), "h": F.lag("height").over(by), "at": F.lag("ifd_offset").over(by), "next": F.lead("data_offset").over(by)})
    checks = [
        (F.col("width") > F.col("w"), "wider than the level before"),
        (F.col("height") > F.col("h"), "higher than the level before"),
        (F.col("ifd_offset") < F.col("at"), "directory before the level before"),
        (F.col("data_offset") < F.col("next"), "data before a smaller level"),
    ]
    errors = F.array_compact(F.array(*[F.when(test, F.lit(text)) for test, text in checks]))
    return seen.select("file_id", "level", F.explode(errors).alias("error"))


def mask_adjacency(image: DataFrame, mask: DataFrame, pad: int = 8) -> DataFrame:
    """Image blocks whose mask block isn't stored right behind them: an equi join with a residual test."""
    m = mask.select("file_id", "block", F.col("offset").alias("mask_offset"))
    return image.join(m, ["file_id", "block"]).where(F.col("mask_offset") != F.col("offset") + F.col("bytecount") + pad).select("file_id", "block", "offset", "bytecount", "mask_offset")


def layout_report(*errors: DataFrame) -> DataFrame:
    """(file_id, n_errors, errors, valid) from (file_id, error) tables."""
    found = reduce(DataFrame.unionByName, [e.select("file_id", "error") for e in errors])
    kinds = found.groupBy("file_id", "error").agg(F.count("*").alias("n"))  # a file's kinds of error are few
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("error", "n"))), lambda x: F.concat(x["error"], F.lit(" ("), x["n"], F.lit(")"))), "; ")
    return kinds.groupBy("file_id").agg(F.sum("n").alias("n_errors"), listed.alias("errors"))
