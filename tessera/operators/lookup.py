"""Lookup joins and decoders of tags, GeoKeys, names and side-car files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numbers import number_text

# Fixed values of the public TIFF and GeoTIFF specifications.
TAG_NAMES = {254: "NewSubfileType", 256: "ImageWidth", 257: "ImageLength", 258: "BitsPerSample", 259: "Compression", 262: "PhotometricInterpretation", 273: "StripOffsets", 277: "SamplesPerPixel", 278: "RowsPerStrip", 279: "StripByteCounts", 284: "PlanarConfiguration", 317: "Predictor", 322: "TileWidth", 323: "TileLength", 324: "TileOffsets", 325: "TileByteCounts", 338: "ExtraSamples", 339: "SampleFormat", 33550: "ModelPixelScaleTag", 33922: "ModelTiepointTag", 34735: "GeoKeyDirectoryTag", 34736: "GeoDoubleParamsTag", 34737: "GeoAsciiParamsTag", 42112: "GDAL_METADATA", 42113: "GDAL_NODATA"}
COMPRESSIONS = {1: "Uncompressed", 5: "LZW", 7: "JPEG", 8: "Deflate", 32773: "PackBits", 34887: "LERC", 50000: "Zstandard"}
SUBFILE_BITS = {1: "Reduced resolution", 2: "Page", 4: "Transparency mask"}
GEOKEYS = {1024: "GTModelTypeGeoKey", 1025: "GTRasterTypeGeoKey", 1026: "GTCitationGeoKey", 2048: "GeodeticCRSGeoKey", 2049: "GeodeticCitationGeoKey", 2057: "EllipsoidSemiMajorAxisGeoKey", 3072: "ProjectedCRSGeoKey", 4096: "VerticalGeoKey"}
MODEL_TYPES = {1: "Projected", 2: "Geographic", 3: "Geocentric"}
DOUBLES, ASCII = 34736, 34737


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def looked_up(key: Column, values: dict, default: str = "Unknown") -> Column:
    """A small fixed table is a constant of the plan, so the lookup needs no join."""
    return F.coalesce(F.get(F.array(F.try_element_at(literal_map(values), key)), F.lit(0)), F.lit(default))


def flags(value: Column, bits: dict[int, str]) -> Column:
    """Names of the set bits."""
    return F.concat_ws(", ", *[F.when(value.bitwiseAND(bit) != 0, F.lit(name)) for bit, name in bits.items()])


def named(df: DataFrame, names: DataFrame, on: str, name: str, default: str = "Unknown") -> DataFrame:
    """Left equi join to a lookup table; what is missing gets the default."""
    return df.join(names, on, "left").withColumn(name, F.coalesce(name, F.lit(default)))


def geokeys(directory: Column, doubles: Column, ascii_text: Column) -> Column:
    """The keys of a directory array: a header of four, then (id, location, count, offset) each.

    A value stands in the entry (location 0), in the doubles, or in the text, there without its closing pipe.  Doubles are
    written in their shortest digits (see functions.numbers.number_text); a value with a null among them is null.
    """
    def key(i: Column) -> Column:
        at = lambda k: F.get(directory, 4 + i * 4 + k)
        loc, n, off = at(1), at(2), at(3)
        part = F.slice(doubles, off + 1, n)
        numbers = F.when(~F.exists(part, lambda x: x.isNull()), F.array_join(F.transform(part, number_text), ", "))
        value = F.when(loc == 0, off.cast("string")).when(loc == DOUBLES, numbers).when(loc == ASCII, F.regexp_replace(F.substr(ascii_text, off + 1, n), r"\|$", ""))
        return F.struct(at(0).alias("id"), loc.alias("location"), n.alias("n"), value.alias("value"))

    return F.transform(F.sequence(F.lit(0), F.get(directory, F.lit(3)) - 1), key)


def with_fallback(df: DataFrame, lookup: DataFrame, name: str, rewrite: Column, code: str = "code") -> DataFrame:
    """Code by case-folded name, else by the rewritten name; lookup: (name, code), one row for each name."""
    folded = lookup.select(F.lower("name").alias("_name"), code)
    first = df.join(folded, F.lower(name) == F.col("_name"), "left").drop("_name")
    again = folded.select(F.col("_name").alias("_again"), F.col(code).alias("_code"))
    return first.join(again, F.when(F.col(code).isNull(), F.lower(rewrite)) == F.col("_again"), "left").withColumn(code, F.coalesce(code, "_code")).drop("_again", "_code")


def first_sidecar(files: DataFrame, existing: DataFrame, candidates: list[Column], path: str = "path") -> DataFrame:
    """(path, sidecar): the first candidate, in order, that exists; null if none does."""
    offered = files.select(path, F.posexplode(F.array(*candidates)).alias("priority", "sidecar"))
    found = offered.join(existing.select(F.col("path").alias("sidecar")).distinct(), "sidecar").groupBy(path).agg(F.min_by("sidecar", "priority").alias("sidecar"))
    return files.select(path).join(found, path, "left")


def first_of_each(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")


def last_match(df: DataFrame, rules: list[tuple[str, str]], text: str, out: str, default: str) -> DataFrame:
    """the value of the last rule whose pattern is found, whatever the case."""
    found: Column = F.lit(default)
    for pattern, value in rules:
        found = F.when(F.col(text).rlike(f"(?i){pattern}"), F.lit(value)).otherwise(found)
    return df.withColumn(out, found)


def overlaid(base: DataFrame, corrections: DataFrame, key: str, value: str) -> DataFrame:
    """Corrections win over base; rows of either side stay."""
    fixes = corrections.select(key, F.col(value).alias("_fix"))
    return base.join(fixes, key, "full").withColumn(value, F.coalesce("_fix", value)).drop("_fix")
