"""Numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

Affine = tuple[float, float, float, float, float, float]


def world(gt: Affine, col: Column, row: Column) -> tuple[Column, Column]:
    """Pixel to world by x0, dx, rx, y0, ry, dy."""
    return F.lit(gt[0]) + col * gt[1] + row * gt[2], F.lit(gt[3]) + col * gt[4] + row * gt[5]


def native_bbox(gt: Affine, width: Column, height: Column, point: Column) -> list[Column]:
    """West, south, east, north of an unrotated image; half a pixel smaller on each side where pixels are points."""
    inset = F.when(point, 0.5).otherwise(0.0)
    west, north = F.lit(gt[0]) + inset * gt[1], F.lit(gt[3]) + inset * gt[5]
    east, south = F.lit(gt[0]) + (width - inset) * gt[1], F.lit(gt[3]) + (height - inset) * gt[5]
    return [c.alias(n) for c, n in ((west, "west"), (south, "south"), (east, "east"), (north, "north"))]


def corners(gt: Affine, width: Column, height: Column) -> Column:
    """Name and world place of the four corners and the centre, for inline()."""
    places = [("Upper Left", 0.0, 0.0), ("Upper Right", 1.0, 0.0), ("Lower Right", 1.0, 1.0), ("Lower Left", 0.0, 1.0), ("Center", 0.5, 0.5)]
    found = []
    for name, a, b in places:
        x, y = world(gt, width * F.lit(a), height * F.lit(b))
        found.append(F.struct(F.lit(name).alias("corner"), x.alias("x"), y.alias("y")))
    return F.array(*found)


def dms(degrees: Column, positive: str, negative: str) -> Column:
    """Degrees, minutes and seconds to two places with the hemisphere's letter."""
    hundredths = F.rint(F.abs(degrees) * 360000).cast("long")
    d, m, s = F.floor(hundredths / 360000), F.floor(hundredths % 360000 / 6000), hundredths % 6000
    return F.format_string("%d° %d' %s\" %s", d, m, F.concat_ws(".", F.lpad(F.floor(s / 100).cast("string"), 2, "0"), F.lpad((s % 100).cast("string"), 2, "0")), F.when(degrees >= 0, positive).otherwise(negative))


def jxl_distance(quality: Column) -> Column:
    """0 (lossless) at 100, else a tenth for each step below, 0.01 at least."""
    return F.when(quality >= 100, 0.0).otherwise(F.greatest(F.rint((100 - quality) * 10) / 100, F.lit(0.01)))


def jxl_quality(distance: Column) -> Column:
    """The estimate that goes back."""
    return F.when(distance <= 0, "lossless").otherwise(F.concat(F.lit("~"), F.rint(100 - distance * 10).cast("long").cast("string")))


def megabytes(size: Column) -> Column:
    """X04."""
    return size / F.lit(1024.0 * 1024.0)


def speed(megabyte: Column, seconds: Column) -> Column:
    """MB/s, 0 without time."""
    return F.when(seconds > 0, megabyte / seconds).otherwise(0.0)


def duration(seconds: Column) -> Column:
    """X11: seconds; minutes and seconds; or hours, minutes and seconds."""
    whole = F.floor(seconds).cast("long")
    h, m, s = F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60
    return F.when(whole < 60, F.concat(s, F.lit("s"))).when(whole < 3600, F.concat(m, F.lit("m "), s, F.lit("s"))).otherwise(F.concat(h, F.lit("h "), m, F.lit("m "), s, F.lit("s")))


def outline(values: Column) -> Column:
    """Every value twice."""
    return F.flatten(F.transform(values, lambda x: F.array(x, x)))


def rounded_half_away(x: Column, places: int) -> Column:
    """x rounded at so many decimal places of its double times a power of ten, halves away from zero; a result of zero keeps its sign, and a number too large for that stays."""
    scaled = F.abs(x) * F.lit(10.0**places)
    near = F.rint(scaled)  # halves to even
    size = F.when(scaled - near == 0.5, near + 1).otherwise(near) / F.lit(10.0**places)
    negative = (x < 0) | (x.cast("string") == "-0.0")
    return F.when(F.isnan(x) | F.isnan(size) | (size == float("inf")), x).when(negative, -size).otherwise(size)


def number_text(x: Column) -> Column:
    """A double in its shortest digits: plain from 0.0001 to under 1e16, else as 1e+16, and nan, inf, -0.0."""
    plain = x.cast("string")
    digits, power = F.regexp_replace(F.substring_index(plain, "E", 1), r"\.0$", ""), F.substring_index(plain, "E", -1).try_cast("int")
    large = F.concat(digits, F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
    whole = F.regexp_replace(F.regexp_replace(plain.try_cast("decimal(38,21)").cast("string"), "0+$", ""), r"\.$", ".0")
    size = F.abs(x)
    text = F.when(~plain.contains("E"), plain).when((size >= 1e-4) & (size < 1e16), whole).otherwise(large)
    return F.when(F.isnan(x), "nan").when(size == float("inf"), F.when(x > 0, "inf").otherwise("-inf")).otherwise(text)
