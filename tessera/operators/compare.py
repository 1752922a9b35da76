"""Comparisons, trials and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import numbers as N

PALETTE = ["red", "green", "blue", "cyan", "magenta", "orange", "purple", "brown", "gray"]
BY_NAME = {"red": "red", "green": "green", "blue": "blue", "alpha": "black", "nir": "magenta"}


def difference(df: DataFrame, key: str) -> DataFrame:
    """One row for each key that has both roles: sizes, delta, percent; from (key, role, size, efficiency).

    A conditional aggregate instead of a self join: one shuffle.
    """
    pick = lambda role, c: F.max(F.when(F.col("role") == role, F.col(c)))
    both = df.groupBy(key).agg(pick("base", "size").alias("base_size"), pick("comp", "size").alias("comp_size"), pick("base", "efficiency").alias("base_eff"), pick("comp", "efficiency").alias("comp_eff"))
    both = both.where("base_size is not null and comp_size is not null")
    delta = F.col("comp_size") - F.col("base_size")
    return both.select(key, "base_size", "comp_size", delta.alias("delta"), F.round(F.try_divide(delta * 100.0, F.col("base_size")), 4).alias("percent"), F.round(F.col("comp_eff") - F.col("base_eff"), 4).alias("eff_delta"))


def verdict(delta: Column, percent: Column, eff_delta: Column, band: float = 0.05) -> Column:
    """Direction of size and efficiency; changes of efficiency within the band are none."""
    size = F.when(delta < 0, F.concat(F.lit("smaller by "), F.abs(F.round(percent, 1)).cast("string"), F.lit(" %"))).when(delta > 0, F.concat(F.lit("larger by "), F.round(percent, 1).cast("string"), F.lit(" %"))).otherwise("of equal size")
    eff = F.when(eff_delta > band, "better compressed").when(eff_delta < -band, "worse compressed").otherwise("equally compressed")
    return F.concat_ws(", ", size, eff)


def skip_reason(algorithm: Column, product: Column, predictor: Column, is_float: Column) -> Column:
    """why a trial can't run; null if it can."""
    return F.when(product.isNull() | (product == ""), "no product type").when(algorithm.isNull() | (algorithm == ""), "no algorithm").when((predictor == 3) & ~is_float, "predictor 3 needs floats")


def trial_ratios(trials: DataFrame) -> DataFrame:
    """Every trial against its file's baseline (trial 0); trials of a file are a bounded grid."""
    by = Window.partitionBy("file_id").orderBy("trial").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = lambda c: F.first(c).over(by)
    return trials.select("file_id", "trial", "size", F.round(N.megabytes(F.col("size")), 6).alias("size_mb"), F.round((1 - F.try_divide(F.col("size").cast("double"), base("size"))) * 100, 4).alias("saved"), F.round(F.try_divide(F.col("seconds"), base("seconds")), 4).alias("time_ratio"), F.round(N.speed(N.megabytes(F.col("size")), F.col("seconds")), 6).alias("mb_per_s"))


def trial_ranks(ratios: DataFrame) -> DataFrame:
    """Ours: the place of each trial by size within its file (Q17)."""
    return ratios.withColumn("place", F.row_number().over(Window.partitionBy("file_id").orderBy("size", "trial")))


def band_colours(bands: DataFrame) -> DataFrame:
    """By band name unless a name, other than alpha, occurs twice in a file; else from the palette in turn."""
    name = F.lower("name")
    counted = bands.withColumn("_n", F.count("*").over(Window.partitionBy("file_id", name)))
    twice = F.max(F.when((F.col("_n") > 1) & (name != "alpha"), True).otherwise(False)).over(Window.partitionBy("file_id"))
    fixed = F.create_map(*[F.lit(x) for p in BY_NAME.items() for x in p])
    palette = F.get(F.array(*[F.lit(c) for c in PALETTE]), ((F.col("band") - 1) % len(PALETTE)).cast("int"))
    return counted.select("file_id", "band", "name", F.when(twice, palette).otherwise(F.coalesce(F.try_element_at(fixed, name), palette)).alias("colour"))


def statistics_table(stats: DataFrame, names: list[str], columns: list[str]) -> DataFrame:
    """Statistics as rows, bands as columns; rows of zeros and nulls alone are left out."""
    long = stats.unpivot(["band_name"], columns, "statistic", "value")
    wide = long.groupBy("statistic").pivot("band_name", names).agg(F.max("value"))
    return wide.where(" or ".join(f"coalesce(`{n}`, 0) <> 0" for n in names))


def section_plan(requested: DataFrame, registry: DataFrame) -> DataFrame:
    """Requested sections in order with what the registry says; unknown ones have status 'unknown'.

    requested: (report, ids, main_page, georeferenced); registry: (id, title, main_only, needs_georeference).
    """
    asked = requested.select("report", "main_page", "georeferenced", F.posexplode("ids").alias("ord", "id"))
    joined = asked.join(F.broadcast(registry), "id", "left")  # the registry is the fixed list of this package's sections
    status = F.when(F.col("title").isNull(), "unknown").when(F.col("main_only") & ~F.col("main_page"), "main page only").when(F.col("needs_georeference") & ~F.col("georeferenced"), "not georeferenced").otherwise("shown")
    return joined.select("report", "ord", "id", F.coalesce("title", F.lit("(missing)")).alias("title"), status.alias("status"))
