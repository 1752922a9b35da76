"""Pixel transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .sizes import bounded

#: Least and largest value of each integer sample type.
INTEGER_LIMITS = {"Byte": (0, 255), "Int8": (-128, 127), "UInt16": (0, 65535), "Int16": (-32768, 32767), "UInt32": (0, 4294967295), "Int32": (-2147483648, 2147483647)}
#: Largest finite value of each float type.
FLOAT_LIMITS = {"Float32": 3.4028234663852886e38, "Float64": 1.7976931348623157e308}


def remapped(value: Column, source: float, target: float) -> Column:
    """Values equal to source (NaN is equal to NaN) become target."""
    return F.when(F.isnan(value) if source != source else value == source, F.lit(target)).otherwise(value)


def rounded(value: Column, decimals: int) -> Column:
    """Half to even on the scaled binary value."""
    return F.rint(value * F.lit(10.0**decimals)) / F.lit(10.0**decimals)


def opaque(alpha: Column, threshold: int = 230) -> Column:
    """P04, P05."""
    return F.when(alpha < threshold, 0).otherwise(255)


def plain_mask(mask: Column) -> Column:
    """Anything but zero is 255."""
    return F.when(mask > 0, 255).otherwise(0)


def nodata_mask(px: DataFrame, nodata: Column, place: list[str], band: str = "band", value: str = "value") -> DataFrame:
    """(place..., mask), 0 where every band that has nodata anywhere has it here, else 255.

    Bands without a nodata pixel don't count; without any such band all is valid.
    """
    flagged = px.withColumn("_none", F.coalesce(nodata, F.lit(False)))
    counting = bounded(flagged.groupBy(band).agg(F.bool_or("_none").alias("_counts")))  # a row for each band
    hidden = F.bool_and(F.when(F.col("_counts"), F.col("_none")))
    return flagged.join(counting, band).groupBy(*place).agg(hidden.alias("_all")).select(*place, F.when(F.col("_all"), 0).otherwise(255).alias("mask"))


def nodata_fits(nodata: Column, dtype: Column, compat: bool = False) -> Column:
    """whether a nodata value can be held by a sample type; compat checks unsigned types as signed ones (Q1), floats strictly (Q2)."""
    limits = dict(INTEGER_LIMITS)
    if compat:
        limits |= {"UInt16": limits["Int16"], "UInt32": limits["Int32"]}
    case = F.lit(False)
    for name, most in FLOAT_LIMITS.items():
        case = F.when(dtype == name, F.isnan(nodata) | (F.abs(nodata) < most)).otherwise(case)
    for name, (low, high) in limits.items():
        case = F.when(dtype == name, ~F.isnan(nodata) & (nodata >= low) & (nodata <= high) & (nodata == F.floor(nodata))).otherwise(case)
    return case


def overview_nearest(tp: DataFrame, factor: int) -> DataFrame:
    """A10, K03 by nearest neighbour: a filter, no shuffle."""
    return tp.where((F.col("row") % factor == 0) & (F.col("col") % factor == 0)).withColumns({"row": (F.col("row") / factor).cast("int"), "col": (F.col("col") / factor).cast("int")})


def overview_mean(tp: DataFrame, factor: int, *keys: str) -> DataFrame:
    """A10 by means of factor x factor cells, an approximation of bilinear resampling."""
    cell = [F.floor(F.col(c) / factor).cast("int").alias(c) for c in ("row", "col")]
    return tp.groupBy(*keys, *cell).agg(F.round(F.sum(F.col("value").cast("decimal(28,9)")).cast("double") / F.count("*"), 6).alias("value"))  # exact sums: the order of the pixels doesn't matter


def overview_levels(width: Column, height: Column, tile: int = 512) -> Column:
    """Powers of two until one tile covers the image, one level at least."""
    n = F.ceil(F.log2(F.greatest(width, height) / F.lit(float(tile))))
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n).cast("int")), lambda i: F.pow(F.lit(2.0), i).cast("int"))


def pyramid_rows(rasters: DataFrame, tile: int = 512) -> DataFrame:
    """(file_id, level, factor, width, height, tiles) of the image and its overviews."""
    levels = rasters.select("file_id", "width", "height", F.posexplode(F.concat(F.array(F.lit(1)), overview_levels(F.col("width"), F.col("height"), tile))).alias("level", "factor"))
    w, h = F.ceil(F.col("width") / F.col("factor")), F.ceil(F.col("height") / F.col("factor"))
    return levels.select("file_id", "level", "factor", w.alias("width"), h.alias("height"), (F.ceil(w / tile) * F.ceil(h / tile)).alias("tiles"))
