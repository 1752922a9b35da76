"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clean_citation(s: Column) -> Column:
    """No outer white space or pipes, inner pipes as line breaks, single spaces."""
    inner = F.regexp_replace(s, r"^[\s|]+|[\s|]+$", "")
    return F.regexp_replace(F.regexp_replace(inner, r"\s*\|+\s*", "<br>"), r" +", " ")


def sanitized(s: Column) -> Column:
    """No control characters but white space, single spaces, no space after a closing bracket."""
    return F.replace(F.trim(F.regexp_replace(F.regexp_replace(s, r"[\x00-\x08\x0E-\x1F\x7F]", ""), r"\s+", " ")), F.lit("> "), F.lit(">"))


def looks_like_xml(s: Column) -> Column:
    """X24."""
    return F.startswith(F.trim(s), F.lit("<")) & F.endswith(F.trim(s), F.lit(">"))


def slug(s: Column) -> Column:
    """Lower case, spaces as hyphens, nothing but letters, digits and hyphens, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(s), r"\s+", "-"), r"[^a-z0-9-]", ""), r"^-+|-+$", "")


def html_escaped(s: Column) -> Column:
    """X31."""
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(sign), F.lit(entity))
    return s


def local_name(tag: Column) -> Column:
    """An element's name without its namespace."""
    return F.regexp_replace(tag, r"^\{.*\}", "")


def replaced(s: Column, rules: list[tuple[str, str]]) -> Column:
    """Rules in order, whatever the case."""
    for pattern, by in rules:
        s = F.regexp_replace(s, f"(?i){pattern}", by)
    return s


def shown_array(values: Column, most: int = 8, first: int = 5) -> Column:
    """All of up to most values, else the first few and the number of all."""
    text = F.transform(values, lambda x: x.cast("string"))
    return F.when(F.size(values) <= most, F.array_join(text, ", ")).otherwise(F.concat(F.array_join(F.slice(text, 1, first), ", "), F.lit(", ... ("), F.size(values), F.lit(" values)")))


def header_order(names: Column) -> Column:
    """Name first, value last, the others in order, each once."""
    others = F.array_sort(F.array_except(names, F.array(F.lit("name"), F.lit("value"))))
    keep = lambda n: F.filter(F.array(F.lit(n)), lambda x: F.array_contains(names, x))
    return F.concat(keep("name"), others, keep("value"))


def name_and_code(name: Column, code: Column) -> Column:
    """P30."""
    return F.when(name.isNull(), F.when(code.isNotNull(), F.concat(F.lit("EPSG:"), code))).when(code.isNull(), name).otherwise(F.concat(name, F.lit(" (EPSG:"), code, F.lit(")")))


def grouped(n: Column) -> Column:
    """A whole number with thousands separators."""
    return F.format_number(n, 0)


def as_boolean(s: Column) -> Column:
    """Null where it is neither."""
    low = F.lower(F.trim(s))
    return F.when(low.isin("true", "t", "yes", "y", "1", "on"), True).when(low.isin("false", "f", "no", "n", "0", "off"), False)


def markdown_row(*cells: Column) -> Column:
    """One row of a table; pipes and line ends can't break it."""
    safe = [F.regexp_replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), r"\r?\n", "<br>") for c in cells]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *safe), F.lit(" |"))
