"""Small files that steer a run: presets, grids, lookups and settings."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession, functions as F

#: A grid of trials for each product: (algorithm, predictor, decimals).
PRESETS = {
    "dem": [("DEFLATE", 2, 2), ("DEFLATE", 3, 2), ("LZW", 2, 2), ("LZW", 3, None), ("ZSTD", 2, 2), ("ZSTD", 3, None)],
    "error": [("DEFLATE", 2, 1), ("LZW", 2, 1), ("ZSTD", 2, 1)],
    "scientific": [("DEFLATE", 3, None), ("DEFLATE", 1, 8), ("LZW", 3, None), ("ZSTD", 3, None)],
    "image": [("DEFLATE", 2, None), ("LZW", 2, None), ("ZSTD", 2, None), ("PACKBITS", 1, None)],
    "thematic": [("DEFLATE", 1, None), ("LZW", 1, None), ("ZSTD", 1, None), ("PACKBITS", 1, None)],
}
PRESETS["gpm"] = PRESETS["error"]


def preset(product: str):
    """The product's grid as options of the test command."""
    from ..plans.pipelines import Options

    if product not in PRESETS:
        raise ValueError(f"no preset for {product}; there are {', '.join(sorted(PRESETS))}")
    return [Options(a, p, d) for a, p, d in PRESETS[product]]


def setting(text: str, dotted: str, default=None):
    """A value of a TOML text by its dotted name."""
    found = tomllib.loads(text)
    for part in dotted.split("."):
        if not isinstance(found, dict) or part not in found:
            return default
        found = found[part]
    return found


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    """(name, code) from JSON lines, names case-folded, the first of equals; an empty table if the path has no rows."""
    rows = spark.read.schema("name string, code long").json(path).where("name is not null")
    return rows.groupBy(F.lower("name").alias("name")).agg(F.min("code").alias("code"))


def write_lookup(lookup: DataFrame, path: str) -> None:
    """A lookup as JSON lines in name order, stamped with the time of writing."""
    lookup.withColumn("compiled", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")).orderBy("name").write.mode("overwrite").json(path)
