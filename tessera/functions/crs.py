"""Coordinate systems (P16, P18, P20, P21, P41, P47, M17): expressions over codes and names; UTM by the published Krueger series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The WGS 84 ellipsoid and the UTM grid.
A_AXIS, FLATTENING, SCALE, EASTING, SOUTH = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0
N1 = FLATTENING / (2 - FLATTENING)
RADIUS = A_AXIS / (1 + N1) * (1 + N1**2 / 4 + N1**4 / 64)
BETA = (N1 / 2 - 2 * N1**2 / 3 + 37 * N1**3 / 96, N1**2 / 48 + N1**3 / 15, 17 * N1**3 / 480)
DELTA = (2 * N1 - 2 * N1**2 / 3 - 2 * N1**3, 7 * N1**2 / 3 - 8 * N1**3 / 5, 56 * N1**3 / 15)


def utm_zone(code: Column) -> Column:
    """Zone of a WGS 84 UTM code (326xx north, 327xx south), negative in the south; null for other codes."""
    return F.when(code.between(32601, 32660), code - 32600).when(code.between(32701, 32760), -(code - 32700))


def utm_to_lonlat(zone: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees, within a millimetre in the zone."""
    xi = (y - F.when(zone < 0, SOUTH).otherwise(0.0)) / (SCALE * RADIUS)
    eta = (x - EASTING) / (SCALE * RADIUS)
    xi1 = xi - sum((F.lit(b) * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(BETA, 1)), F.lit(0.0))
    eta1 = eta - sum((F.lit(b) * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(BETA, 1)), F.lit(0.0))
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    lat = chi + sum((F.lit(d) * F.sin(2 * j * chi) for j, d in enumerate(DELTA, 1)), F.lit(0.0))
    return F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))) + F.abs(zone) * 6 - 183, F.degrees(lat)


def extents(points: DataFrame, key: str) -> DataFrame:
    """West, south, east and north of each key's corners; a missing corner counts as (0, 0)."""
    x, y = F.coalesce("x", F.lit(0.0)), F.coalesce("y", F.lit(0.0))
    return points.groupBy(key).agg(F.min(x).alias("west"), F.min(y).alias("south"), F.max(x).alias("east"), F.max(y).alias("north"))


def with_heights(boxes: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """P20: bottom and top of a box from its raster's statistics, if it has one band."""
    one = stats.groupBy(key).agg(F.count("*").alias("_bands"), F.min("minimum").alias("bottom"), F.max("maximum").alias("top")).where("_bands = 1").drop("_bands")
    return boxes.join(one, key, "left")


def chosen_crs(product: Column, horizontal: Column, vertical: Column, asked_vertical: Column) -> Column:
    """Elevation products get a compound system, of the vertical part asked for or else found; others only their horizontal one."""
    v = F.coalesce(asked_vertical, vertical)
    return F.when(~product.isin("dem", "error") | v.isNull(), horizontal).otherwise(F.concat(horizontal, F.lit(" + "), v))


def target_nodata(product: Column, codec: Column, nodata: Column, asked: Column) -> Column:
    """What was asked for; a LERC file can't keep NaN and gets -32767; else what there is."""
    return F.coalesce(asked, F.when((codec == "LERC") & F.isnan(nodata), -32767.0).otherwise(nodata))
