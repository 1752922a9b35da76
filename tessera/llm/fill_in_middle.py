"""Fill-in-middle texts from relational units (operator 12).

A text is cut into units by a pattern.  One row a document with its units' lengths goes to the
document's task, where posexplode makes a row of each unit and a window sums their lengths up.
Each document requests two cuts by unit ordinal; requests join the sums by (document, ordinal),
the two offsets are aggregated per document and substring cuts the text there.

Documents are told apart by a 128-bit digest of key and text, so texts under one key, or without
one, don't mix; equal rows are worked out once.  Texts move once, for the last join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

LINES = "[^\\n]*\\n|[^\\n]+"
MARKS = ("<P>", "<S>", "<M>")


def draws(key: Column, seed: int, n: int = 4) -> list[Column]:
    """The first n 8-digit groups of the hex sha256 of seed:key, as numbers; a null key draws like an empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(n)]


def rebuilt(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that output was made of."""
    p, s, m = (F.instr(output, x) for x in marks)
    between = lambda mark, at, end: F.substring(output, at + len(mark), end - at - len(mark))
    last = F.substring(output, m + len(marks[2]), F.char_length(output))
    psm = F.concat(between(marks[0], p, s), last, between(marks[1], s, m))
    spm = F.concat(between(marks[0], p, m), last, between(marks[1], s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, seed: int, fim_percent: int = 100, spm_percent: int = 50, unit: str = LINES, marks: tuple[str, str, str] = MARKS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, text, output) for every row of docs.

    n: units of the text.  Prefix and middle end after as many units as draws of (seed, key) say,
    the suffix is the rest.  form psm: marks[0] prefix marks[1] suffix marks[2] middle; spm: marks[1]
    suffix marks[0] prefix marks[2] middle; plain: the text as it is, where it is empty, holds a mark or the draw
    leaves it out; prefix_chars and middle_chars (code points) are null then.  Null texts count as
    empty; repeated rows are all returned; columns of docs besides key and text don't matter; an
    empty table gives none.  A mark's first character must stand nowhere else in the marks, which
    lets rebuilt find them.
    """
    if len(set(marks)) < 3 or any(not m or m[0] in x[1:] for m in marks for x in marks):
        raise ValueError("marks must differ, and their first characters stand nowhere else in them")
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("*", F.xxhash64("key", "text").alias("id_a"), F.xxhash64(F.lit(seed), "text", "key").alias("id_b"))
    h1, h2, h3, h4 = draws(F.col("key"), seed)
    plain = (F.col("text") == "") | (h3 % 100 >= fim_percent)
    for m in marks:
        plain = plain | F.contains(F.col("text"), F.lit(m))
    rows = rows.withColumn("form", F.when(plain, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm"))
    cuts = lambda n: (F.least(h1 % (n + 1), h2 % (n + 1)), F.greatest(h1 % (n + 1), h2 % (n + 1)))
    ids = ["id_a", "id_b"]

    # One row a different document: the lengths of its units up to the later cut, and the cuts.
    cut = rows.where("form <> 'plain'").select(*ids, "key", F.transform(F.regexp_extract_all("text", F.lit(unit), F.lit(0)), F.char_length).alias("lengths"))
    low, high = cuts(F.size("lengths"))
    cut = cut.select(*ids, low.cast("int").alias("low"), high.cast("int").alias("high"), F.slice("lengths", F.lit(1), high.cast("int")).alias("lengths"))
    cut = cut.groupBy(*ids).agg(F.first("low").alias("low"), F.first("high").alias("high"), F.first("lengths").alias("lengths"))
    units = cut.select(*ids, "low", "high", F.posexplode("lengths").alias("ordinal", "length"))
    upto = F.sum("length").over(Window.partitionBy(*ids).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0))
    sums = units.select(*ids, "low", "high", (F.col("ordinal") + 1).alias("cut"), upto.alias("upto")).where("cut = low or cut = high").select(*ids, "cut", "upto")
    requests = cut.select(*ids, F.posexplode(F.array("low", "high")).alias("which", "cut"))
    offset = lambda which: F.max(F.when(F.col("which") == which, F.coalesce("upto", F.lit(0)))).cast("int")
    offsets = requests.join(sums, [*ids, "cut"], "left").groupBy(*ids).agg(offset(0).alias("begin"), offset(1).alias("end"))

    found = rows.join(offsets, ids, "left")
    t, begin, end = F.col("text"), F.col("begin"), F.col("end")
    prefix, middle, suffix = F.substring(t, F.lit(1), begin), F.substring(t, begin + 1, end - begin), F.substring(t, end + 1, F.char_length(t))
    p, s, m = (F.lit(x) for x in marks)
    output = F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(t)
    return found.select(
        F.col("key").alias(key),
        F.regexp_count("text", F.lit(unit)).cast("long").alias("n"),
        "form",
        begin.cast("long").alias("prefix_chars"),
        (end - begin).cast("long").alias("middle_chars"),
        F.col("text").alias(text),
        output.alias("output"),
    )
