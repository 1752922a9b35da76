"""Masked band statistics, histograms and precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .sizes import bounded

MOST_BINS = 100


def is_finite(v: Column) -> Column:
    return ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def valid(value: Column) -> Column:
    """No source of invalidity holds, and the value is finite."""
    return ~(F.col("is_nodata") | F.col("is_masked") | F.col("is_alpha0") | F.isnan(value)) & is_finite(value)


def band_statistics(px: DataFrame, *keys: str) -> DataFrame:
    """One scan, one partially aggregated shuffle; NaN counts as nodata with or without a nodata value."""
    v = F.when(valid(F.col("value")), F.col("value"))
    return px.groupBy(*keys).agg(
        F.count("*").alias("pixels"),
        F.count(v).alias("valid_count"),
        F.count_if(F.col("is_nodata") | F.isnan("value")).alias("nodata_count"),
        F.count_if("is_masked").alias("mask_count"),
        F.count_if("is_alpha0").alias("alpha_0_count"),
        F.round(F.count(v) * 100.0 / F.count("*"), 6).alias("valid_percent"),
        F.min(v).alias("minimum"),
        F.max(v).alias("maximum"),
        F.round(F.avg(v), 6).alias("mean"),
        F.round(F.stddev_pop(v), 6).alias("std_dev"),
        F.round(F.median(v), 6).alias("median"),
    )


def quantiles_by_refinement(px: DataFrame, probabilities: list[float], *keys: str, bins: int = 1024, passes: int = 3) -> DataFrame:
    """A03 beyond memory: (keys, p, quantile), equal to percentile(value, p) over valid pixels.

    percentile holds a count for every distinct value of a group.  Here each pass counts, by a
    partial aggregate, the values of bins of the interval that holds a wanted rank and goes on
    with that bin; after passes rounds only the values of a bins ** passes-th of the range are
    grouped by value.  For bands whose pixels have too many different values to hold.
    """
    valid_px = px.where(valid(F.col("value"))).select(*keys, "value")
    by = [*keys, "rank"]
    base = valid_px.groupBy(*keys).agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    place = (F.col("n") - 1) * F.col("p")
    wanted = base.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])))
    ranks = bounded(wanted.select(*keys, "p", F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place)))).alias("rank"), "n", "lo", "hi"))
    spans = bounded(ranks.select(*by, "lo", "hi", F.lit(0).cast("long").alias("below")).distinct())
    for _ in range(passes):
        width = (F.col("hi") - F.col("lo")) / bins
        inside = valid_px.join(spans, list(keys)).where(F.col("value").between(F.col("lo"), F.col("hi")))
        slot = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("value") - F.col("lo")) / width))).otherwise(0)
        counted = inside.groupBy(*by, slot.alias("slot")).agg(F.count("*").alias("m"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.first("below").alias("below"))
        upto = F.sum("m").over(Window.partitionBy(*by).orderBy("slot"))  # bins rows at most in a group
        spans = bounded(counted.withColumn("upto", F.col("below") + upto).where("rank < upto and rank >= upto - m").select(*by, "lo", "hi", (F.col("upto") - F.col("m")).alias("below")))
    last = valid_px.join(spans, list(keys)).where(F.col("value").between(F.col("lo"), F.col("hi")))
    values = last.groupBy(*by, "value").agg(F.count("*").alias("m"), F.first("below").alias("below"))
    upto = F.col("below") + F.sum("m").over(Window.partitionBy(*by).orderBy("value"))
    found = values.withColumn("upto", upto).where("rank < upto and rank >= upto - m").select(*by, "value")
    both = ranks.join(found, by).groupBy(*keys, "p").agg(F.min("value").alias("a"), F.max("value").alias("b"), F.first("n").alias("n"))
    part = place - F.floor(place)
    return both.select(*keys, "p", F.when(part == 0, F.col("a")).otherwise(F.col("a") * (1 - part) + F.col("b") * part).alias("quantile"))


def histogram_plan(px: DataFrame, *keys: str) -> DataFrame:
    """Bins of each band (A04): 256 on [0, 256] for byte data, else by the Freedman-Diaconis width, at most MOST_BINS."""
    v = F.when(valid(F.col("value")), F.col("value"))
    sums = px.groupBy(*keys).agg(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.percentile(v, F.array(F.lit(0.25), F.lit(0.75))).alias("q"), F.bool_and(F.when(v.isNotNull(), v.between(0, 255) & (v % 1 == 0))).alias("bytes")).where("n > 0")
    width = 2 * (F.col("q")[1] - F.col("q")[0]) * F.pow(F.col("n").cast("double"), F.lit(-1 / 3))
    spread = F.col("hi") - F.col("lo")
    bins = F.when(F.col("bytes"), 256).when(spread <= 0, 1).when(width <= 0, MOST_BINS).otherwise(F.least(F.lit(MOST_BINS), F.ceil(F.try_divide(spread, width))))
    return sums.select(*keys, F.when(F.col("bytes"), 0.0).otherwise(F.col("lo")).alias("lo"), F.when(F.col("bytes"), 256.0).when(spread <= 0, F.col("hi") + 1).otherwise(F.col("hi")).alias("hi"), bins.cast("int").alias("bins"))


def edge(i: Column) -> Column:
    """The i-th of bins + 1 even edges."""
    return F.when(i >= F.col("bins"), F.col("hi")).otherwise(F.col("lo") + i * ((F.col("hi") - F.col("lo")) / F.col("bins")))


def histogram(px: DataFrame, plan: DataFrame, *keys: str) -> DataFrame:
    """(keys, bin, left, right, count) with the empty bins; a value on an edge lies right of it, the maximum in the last bin.

    plan has one row for each band; bins come out of a partial aggregate, so no band meets in a task.
    """
    plan = bounded(plan)
    at = px.where(valid(F.col("value"))).join(plan, list(keys)).where(F.col("value").between(F.col("lo"), F.col("hi")))
    guess = F.greatest(F.lit(0), F.least(F.col("bins") - 1, F.floor((F.col("value") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / F.col("bins")))))
    at = at.withColumn("g", guess.cast("int"))
    fixed = F.when(F.col("value") < edge(F.col("g")), F.col("g") - 1).when((F.col("value") >= edge(F.col("g") + 1)) & (F.col("g") < F.col("bins") - 1), F.col("g") + 1).otherwise(F.col("g"))
    counts = at.groupBy(*keys, fixed.alias("bin")).agg(F.count("*").alias("count"))
    every = plan.select(*keys, "lo", "hi", "bins", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    return every.join(counts, [*keys, "bin"], "left").select(*keys, "bin", edge(F.col("bin")).alias("left"), edge(F.col("bin") + 1).alias("right"), F.coalesce("count", F.lit(0)).alias("count"))


def pam_plan(px: DataFrame, *keys: str, dtype: Column | None = None) -> DataFrame:
    """Bins of the side-car histogram (A05) by sample type, which is one for a band (without dtype: a float or signed one).

    Byte: 256 on [0, 256].  Other unsigned types: maximum - minimum, 256 at most, from -0.5 to
    maximum + 0.5.  Floats and signed integers: 256 on [minimum, maximum].  A constant band that
    isn't Byte has one bin; bands without valid pixels have none.
    """
    v = F.when(valid(F.col("value")), F.col("value"))
    kind = F.lit(None).cast("string") if dtype is None else dtype
    sums = px.groupBy(*keys).agg(F.min(v).alias("least"), F.max(v).alias("most"), F.max(kind).alias("kind")).where("least is not null")
    least, most, byte, unsigned = F.col("least"), F.col("most"), F.col("kind") == "Byte", F.col("kind").startswith("UInt")
    lo = F.when(byte, 0.0).when(unsigned, -0.5).otherwise(least)
    hi = F.when(byte, 256.0).when(unsigned, most + 0.5).when(most > least, most).otherwise(least + 1)
    bins = F.when(byte, 256).when(unsigned, F.greatest(F.lit(1.0), F.least(F.lit(256.0), most - least)).cast("int")).when(most > least, 256).otherwise(1)
    return sums.select(*keys, lo.alias("lo"), hi.alias("hi"), bins.alias("bins"))


def density(hist: DataFrame, *keys: str) -> DataFrame:
    """Counts over the sum of count times width; bins of a band are bounded, so the window is small."""
    area = F.sum(F.col("count") * (F.col("right") - F.col("left"))).over(Window.partitionBy(*keys))
    return hist.withColumn("density", F.try_divide(F.col("count").cast("double"), area))


def decimal_places(value: Column, most: int = 7) -> Column:
    """The fewest decimal places that give the value back; 0 for null and what isn't finite."""
    tries = F.sequence(F.lit(0), F.lit(most))
    good = F.filter(tries, lambda n: F.abs(value - F.rint(value * F.pow(F.lit(10.0), n)) / F.pow(F.lit(10.0), n)) < F.lit(10.0 ** -(most + 2)))
    return F.when(value.isNull() | ~is_finite(value), 0).otherwise(F.coalesce(F.get(good, F.lit(0)), F.lit(most)))


def most_decimals(px: DataFrame, *keys: str, most: int = 7) -> DataFrame:
    """The largest number of decimal places among a band's values that aren't nodata."""
    return px.where(~F.col("is_nodata") & is_finite(F.col("value"))).groupBy(*keys).agg(F.max(decimal_places(F.col("value"), most)).alias("decimals"))
