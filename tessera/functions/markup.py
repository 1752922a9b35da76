"""WKT, XML and JSON text.

The grammars are recursive, which column expressions can't be, so these are Arrow-batched
pandas UDFs; each text is one row and stays in its task.
"""

from __future__ import annotations

import json
import re
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Types, not their text: that could only be read with a session.
_DESCRIPTION = T.StructType([T.StructField(n, T.IntegerType() if n == "code" else T.StringType()) for n in ("kind", "name", "code", "horizontal", "vertical")])
_ELEMENTS = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType() if n in ("ord", "level") else T.StringType()) for n in ("ord", "level", "name", "value", "attributes")]))
_CODE = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "text")]))


def wkt_parts(body: str) -> list[str]:
    """The comma-separated parts of a WKT node's inside: commas in brackets or quotes don't part."""
    parts, depth, quoted, at = [], 0, False, 0
    for i, c in enumerate(body):
        if c == '"':
            quoted = not quoted
        elif not quoted:
            depth += (c in "[(") - (c in "])")
            if c == "," and not depth:
                parts.append(body[at:i].strip())
                at = i + 1
    last = body[at:].strip()
    return [*parts, last] if last else parts


_NODE = re.compile(r"^\s*([A-Za-z_0-9]+)\s*[\[(](.*)[\])]\s*$", re.DOTALL)


def wkt_node(text: str) -> tuple[str, list[str]] | None:
    m = _NODE.match(text or "")
    return (m[1].upper(), wkt_parts(m[2])) if m else None


def wkt_indented(text: str, level: int = 0, step: str = "    ") -> str:
    """A node a line below its parent; plain values stay on the node's line."""
    node = wkt_node(text)
    if node is None:
        return step * level + text.strip()
    name, parts = node
    plain = [p for p in parts if wkt_node(p) is None]
    inner = [wkt_indented(p, level + 1, step) for p in parts if wkt_node(p) is not None]
    return step * level + name + "[" + ", ".join(plain) + ("".join(",\n" + x for x in inner) if inner else "") + "]"


_HORIZONTAL = {"PROJCS", "PROJCRS", "GEOGCS", "GEOGCRS", "GEODCRS", "BOUNDCRS"}
_VERTICAL = {"VERT_CS", "VERTCRS", "VERTICALCRS", "VERTCS"}


def wkt_description(text: str) -> dict:
    """Name, EPSG code and kind of a CRS; for a compound one also its horizontal and vertical parts."""
    out = {"kind": None, "name": None, "code": None, "horizontal": None, "vertical": None}
    node = wkt_node(text)
    if node is None:
        return out
    kind, parts = node
    out |= {"kind": kind, "name": parts[0].strip('"') if parts else None}
    for p in parts[1:]:
        child = wkt_node(p)
        if child and child[0] in ("AUTHORITY", "ID") and len(child[1]) > 1 and child[1][0].strip('"').upper() == "EPSG":
            digits = child[1][1].strip('"')
            out["code"] = int(digits) if digits.isdigit() else None
        elif child and child[0] in _HORIZONTAL and kind in ("COMPD_CS", "COMPOUNDCRS"):
            out["horizontal"] = p
        elif child and child[0] in _VERTICAL:
            out["vertical"] = p
    if kind in _HORIZONTAL:
        out["horizontal"] = text
    elif kind in _VERTICAL:
        out["vertical"] = text
    return out


@F.pandas_udf(T.StringType())
def indented_wkt(texts: pd.Series) -> pd.Series:
    """X33."""
    return texts.map(lambda t: None if t is None else wkt_indented(t))


@F.pandas_udf(_DESCRIPTION)
def described_wkt(texts: pd.Series) -> pd.DataFrame:
    """P17, P46, X34."""
    found = pd.DataFrame([wkt_description(t) for t in texts], columns=["kind", "name", "code", "horizontal", "vertical"])
    return found.astype({"code": "Int32"})


def compound_wkt(name: Column, horizontal: Column, vertical: Column) -> Column:
    """P45."""
    return F.concat(F.lit('COMPD_CS["'), name, F.lit('",'), horizontal, F.lit(","), vertical, F.lit("]"))


def xml_rows_of(text: str | None) -> list[tuple[int, int, str, str | None, str | None]]:
    """(place, level, name, value, attributes as JSON) of every element, in document order; an empty list if the text isn't well formed."""
    try:
        root = ElementTree.fromstring(text or "")
    except ElementTree.ParseError:
        return []
    rows: list[tuple[int, int, str, str | None, str | None]] = []
    waiting = [(root, 0)]
    while waiting:
        node, level = waiting.pop()
        value = (node.text or "").strip() or None
        attributes = json.dumps(dict(sorted(node.attrib.items())), ensure_ascii=False) if node.attrib else None
        rows.append((len(rows), level, re.sub(r"^\{.*\}", "", node.tag), value, attributes))
        waiting += [(child, level + 1) for child in reversed(node)]
    return rows


@F.pandas_udf(_ELEMENTS)
def xml_rows(texts: pd.Series) -> pd.Series:
    """Explode it for a row an element."""
    return pd.Series([[dict(zip(("ord", "level", "name", "value", "attributes"), r, strict=True)) for r in xml_rows_of(t)] for t in texts])


@F.pandas_udf(T.BooleanType())
def is_xml(texts: pd.Series) -> pd.Series:
    """F05."""
    return pd.Series([bool(xml_rows_of(t)) for t in texts], dtype=bool)


@F.pandas_udf(T.StringType())
def pretty_xml(texts: pd.Series) -> pd.Series:
    """An element a line; null if the text isn't well formed."""

    def pretty(t: str | None) -> str | None:
        try:
            root = ElementTree.fromstring(t or "")
        except ElementTree.ParseError:
            return None
        ElementTree.indent(root)
        return ElementTree.tostring(root, encoding="unicode")

    return texts.map(pretty)


@F.pandas_udf(T.StringType())
def pretty_json(texts: pd.Series) -> pd.Series:
    """Null if the text isn't JSON."""

    def pretty(t: str | None) -> str | None:
        try:
            return json.dumps(json.loads(t), indent=2, ensure_ascii=False)
        except (TypeError, ValueError):
            return None

    return texts.map(pretty)


_TOKENS = re.compile(r'(?P<string>"(?:[^"\\]|\\.)*")|(?P<number>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<word>[A-Za-z_]\w*)|(?P<sign>[\[\]{}(),:])')


@F.pandas_udf(_CODE)
def code_tokens(texts: pd.Series) -> pd.Series:
    """The strings, numbers, words and signs of WKT or JSON, for highlighting."""
    return pd.Series([[{"kind": m.lastgroup, "text": m[0]} for m in _TOKENS.finditer(t or "")] for t in texts])


@F.pandas_udf(T.StringType())
def significant(values: pd.Series) -> pd.Series:
    """Seven significant digits, no negative zero; null stays null."""
    return values.map(lambda v: None if pd.isna(v) else f"{v + 0.0:.7g}" if v != 0 else "0")


def decoded(content: Column) -> Column:
    """Bytes as UTF-8, else as Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def pam_xml(stats: Column) -> Column:
    """A band's statistics as side-car items."""
    item = lambda key, c: F.concat(F.lit(f'<MDI key="STATISTICS_{key}">'), F.coalesce(stats[c].cast("string"), F.lit("")), F.lit("</MDI>"))
    return F.concat(F.lit('<PAMRasterBand band="'), stats["band"].cast("string"), F.lit('"><Metadata>'), item("MAXIMUM", "maximum"), item("MEAN", "mean"), item("MINIMUM", "minimum"), item("STDDEV", "std_dev"), item("VALID_PERCENT", "valid_percent"), F.lit("</Metadata></PAMRasterBand>"))
