"""Display of camera tags (X26) as JVM expressions over sources.tiff.exif's columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values of the public EXIF specification.
EXPOSURE_TIME, F_NUMBER, PROGRAM, SHUTTER, APERTURE, BRIGHTNESS, BIAS = 33434, 33437, 34850, 37377, 37378, 37379, 37380
METERING, FLASH, FOCAL_LENGTH, LENS = 37383, 37385, 37386, 42034
PROGRAMS = {0: "Not defined", 1: "Manual", 2: "Normal program", 3: "Aperture priority", 4: "Shutter priority", 5: "Creative program", 6: "Action program", 7: "Portrait mode", 8: "Landscape mode"}
MODES = {0: "Unknown", 1: "Average", 2: "Center-weighted average", 3: "Spot", 4: "Multi-spot", 5: "Pattern", 6: "Partial", 255: "Other"}


def fixed(value: Column, places: int) -> Column:
    """A number with so many places, ties to the even digit."""
    return F.when(value.isNotNull(), F.format_string(f"%.{places}f", F.bround(value, places)))


def whole(value: Column) -> Column:
    return value.cast("long").cast("string")


def with_name(value: Column, names: dict[int, str]) -> Column:
    name = F.coalesce(*[F.when(value == k, F.lit(v)) for k, v in names.items()], F.lit("Unknown"))
    return F.concat(whole(value), F.lit(" ("), name, F.lit(")"))


def ratio(numbers: Column, denominators: Column, i: int) -> Column:
    """The i-th rational's value; null over zero."""
    return F.try_divide(F.get(numbers, F.lit(i)), F.get(denominators, F.lit(i)))


def lens(numbers: Column, denominators: Column) -> Column:
    """Least and greatest focal length and aperture; unknown ones, over zero, count as 0."""
    a, b, c, d = (fixed(F.coalesce(ratio(numbers, denominators, i), F.lit(0.0)), 1) for i in range(4))
    return F.concat(a, F.lit("-"), b, F.lit("mm f/"), c, F.lit("-"), d)


def shown(code: Column, numbers: Column, denominators: Column, text: Column) -> Column:
    """The display text of a tag; null for a rational over zero."""
    first, below = F.get(numbers, F.lit(0)), F.get(denominators, F.lit(0))
    value = ratio(numbers, denominators, 0)
    every = F.zip_with(numbers, denominators, lambda n, d: fixed(F.try_divide(n, d), 3))
    one = (
        F.when(code == EXPOSURE_TIME, F.concat_ws("/", whole(first), whole(below)))
        .when(code.isin(F_NUMBER, APERTURE), F.concat(F.lit("f/"), fixed(value, 1)))
        .when(code == FOCAL_LENGTH, F.concat(fixed(value, 1), F.lit("mm")))
        .when(code.isin(SHUTTER, BRIGHTNESS, BIAS), fixed(value, 2))
        .otherwise(fixed(value, 3))
    )
    many = F.when((code == LENS) & (F.size(numbers) >= 4), lens(numbers, denominators)).when(~F.exists(every, lambda x: x.isNull()), F.array_join(every, ", "))
    fired = F.when(first.cast("long").bitwiseAND(1) == 1, "Flash fired").otherwise("Flash did not fire")
    plain = F.transform(numbers, lambda x: F.when(x == x.cast("long"), whole(x)).otherwise(x.cast("string")))
    return (
        F.when(text.isNotNull(), text)
        .when(denominators.isNotNull() & (F.size(numbers) == 1), one)
        .when(denominators.isNotNull(), many)
        .when(code == PROGRAM, with_name(first, PROGRAMS))
        .when(code == METERING, with_name(first, MODES))
        .when(code == FLASH, F.concat(whole(first), F.lit(" ("), fired, F.lit(")")))
        .otherwise(F.array_join(plain, ", "))
    )
