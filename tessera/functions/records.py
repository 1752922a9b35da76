"""Record predicates and display strings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def is_north_up(gt: Column) -> Column:
    """No rotation terms; gt: array x0, dx, rx, y0, ry, dy."""
    return (F.get(gt, F.lit(2)) == 0) & (F.get(gt, F.lit(4)) == 0)


def resolution(gt: Column) -> Column:
    """Pixel size as lengths of the transform's columns."""
    length = lambda a, b: F.sqrt(F.get(gt, F.lit(a)) * F.get(gt, F.lit(a)) + F.get(gt, F.lit(b)) * F.get(gt, F.lit(b)))
    return F.struct(length(1, 4).alias("x"), length(2, 5).alias("y"))


def predictor_label(predictor: Column, codec: Column) -> Column:
    """The predictor's name where the codec uses one."""
    name = F.when(predictor == 1, "None").when(predictor == 2, "Horizontal differencing").when(predictor == 3, "Floating point").otherwise(F.concat(F.lit("Unknown ("), predictor, F.lit(")")))
    return F.when(codec.isin("LZW", "Deflate", "Zstandard"), name).otherwise("n/a")


def is_tiled(block: Column) -> Column:
    """Whether a block text 'w x h' is a tile: more than one row and a width in sixteens."""
    w, h = (F.get(F.split(block, " x "), F.lit(i)).try_cast("int") for i in (0, 1))
    return F.coalesce((h > 1) & (w % 16 == 0), F.lit(False))


def layout_status(errors: Column, warnings: Column) -> Column:
    """P36, M09."""
    return F.when(errors > 0, F.concat(F.lit("invalid: "), errors, F.lit(" errors"))).when(warnings > 0, F.concat(F.lit("valid with "), warnings, F.lit(" warnings"))).otherwise("valid")


def area_or_point(asked: Column, product: Column) -> Column:
    """What was asked for, else points for elevation and error rasters."""
    return F.coalesce(asked, F.when(product.isin("dem", "error"), "Point").otherwise("Area"))


def carried(metadata: Column, drop: list[str], add: dict[str, str]) -> Column:
    """Metadata without some keys and with others, which win."""
    kept = F.map_filter(metadata, lambda k, _: ~k.isin([*drop, *add]))
    return F.map_concat(kept, F.create_map(*[F.lit(x) for p in add.items() for x in p]))


def range_text(lo: Column, hi: Column, count: Column) -> Column:
    """The range of a band with valid pixels."""
    return F.when(count > 0, F.concat(lo.cast("string"), F.lit(" to "), hi.cast("string"))).otherwise("no valid pixels")


def jpeg_tables(raw: Column) -> Column:
    """Which tables a JPEG stream holds, and its length."""
    named = F.concat_ws(", ", F.when(F.contains(raw, F.lit(b"\xff\xdb")), F.lit("quantisation")), F.when(F.contains(raw, F.lit(b"\xff\xc4")), F.lit("Huffman")))
    return F.concat(F.when(named == "", F.lit("no tables")).otherwise(named), F.lit(" ("), F.octet_length(raw), F.lit(" bytes)"))


def wrap_marks(s: Column, every: str = "/") -> Column:
    """Zero-width spaces after a sign, so long texts can wrap."""
    return F.replace(s, F.lit(every), F.lit(every + "​"))


def without_marks(s: Column) -> Column:
    return F.replace(s, F.lit("​"), F.lit(""))


def vertical_differs(asked: Column, found: Column) -> Column:
    """neither name is part of the other, whatever the case."""
    a, b = F.lower(asked), F.lower(found)
    return F.coalesce(~(F.contains(a, b) | F.contains(b, a)), F.lit(False))
