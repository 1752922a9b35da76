"""Pyramids of blocks too large for one task (K03, A10, P22): bilinear and nearest overviews with halos.

A raster is a table of blocks: (path, level, band, by, bx, width, height, data), data the bytes of
tile x tile doubles, NaN where there is no value, width and height the level's.  A level comes
from the one below by one shuffle: each block sends itself to the block of the level above that
covers it, and its outermost row or column to that block's neighbours.  No task has more than
four blocks and their halo.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..sources.folders import kept

BLOCKS = "path string, level int, band int, by int, bx int, width long, height long, data binary"
#: Bilinear weights of the four samples around the centre of two, as the triangle of twice the width has them.
WEIGHTS = (0.125, 0.375, 0.375, 0.125)
RESAMPLINGS = ("bilinear", "nearest")


def blocks_of(segments: DataFrame, sizes: DataFrame, tile: int, nodata: DataFrame | None = None) -> DataFrame:
    """Level 0 of segments (path, band, row, col, data array<double>) of sizes (path, width, height); nodata: (path, nodata), whose value becomes NaN.

    Segments are cut at block borders, so a block gets only its own samples.  A block without any is there too, of NaN
    alone; a file's bands are those up to the highest that its segments name.
    """
    first, last = F.floor(F.col("col") / tile), F.floor((F.col("col") + F.size("data") - 1) / tile)
    cut = segments.withColumn("bx", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    begin = F.greatest(F.col("col"), F.col("bx") * tile)
    cut = cut.select("path", "band", F.floor(F.col("row") / tile).cast("int").alias("by"), "bx", (F.col("row") % tile).alias("r"), (begin - F.col("bx") * tile).alias("c"), F.slice("data", (begin - F.col("col") + 1).cast("int"), F.lit(tile) - (begin - F.col("bx") * tile).cast("int")).alias("data"))
    grid = segments.groupBy("path").agg(F.max("band").alias("bands")).join(sizes.select("path", "width", "height"), "path")
    upto = lambda size: F.explode(F.sequence(F.lit(0), (F.ceil(F.col(size) / tile) - 1).cast("int")))
    grid = grid.withColumn("band", F.explode(F.sequence(F.lit(1), F.col("bands")))).withColumn("by", upto("height")).withColumn("bx", upto("width"))
    cut = cut.unionByName(grid.select("path", "band", "by", "bx", F.lit(0).alias("r"), F.lit(0).alias("c"), F.array().cast("array<double>").alias("data")))
    cut = cut.join(sizes.select("path", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height")), "path")
    cut = cut.withColumn("nodata", F.lit(None).cast("double")) if nodata is None else cut.join(nodata.select("path", F.col("nodata").cast("double")), "path", "left")

    def paste(group: pd.DataFrame) -> pd.DataFrame:
        head = group.iloc[0]
        canvas = np.full((tile, tile), np.nan)
        for r, c, values in zip(group["r"], group["c"], group["data"], strict=True):
            canvas[r, c : c + len(values)] = values
        if head.nodata is not None and not np.isnan(head.nodata):
            canvas[canvas == head.nodata] = np.nan
        return pd.DataFrame([(head.path, 0, head.band, head.by, head.bx, head.width, head.height, canvas.tobytes())], columns=[c.split()[0] for c in BLOCKS.split(", ")])

    return cut.groupBy("path", "band", "by", "bx").applyInPandas(paste, BLOCKS)


def halved(canvas: np.ndarray, resampling: str) -> np.ndarray:
    """Every second sample, or bilinear means, of a canvas with a halo of one; NaN has no weight."""
    if resampling == "nearest":
        return canvas[1:-1:2, 1:-1:2]
    rows, columns = (canvas.shape[0] - 2) // 2, (canvas.shape[1] - 2) // 2
    known = (~np.isnan(canvas)).astype(np.float64)
    value = np.where(known > 0, canvas, 0.0)

    def sums(x: np.ndarray) -> np.ndarray:
        down = sum(w * x[i : i + 2 * rows : 2] for i, w in enumerate(WEIGHTS))
        return sum(w * down[:, i : i + 2 * columns : 2] for i, w in enumerate(WEIGHTS))

    total, weight = sums(value), sums(known)
    return np.where(weight > 0, total / np.where(weight > 0, weight, 1.0), np.nan)


def overview(blocks: DataFrame, tile: int, resampling: str = "bilinear") -> DataFrame:
    """The level above blocks: half as wide and high, rounded up."""
    if resampling not in RESAMPLINGS:
        raise ValueError(f"unknown resampling {resampling}")

    def sent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in batch.itertuples(index=False):
                h, w = min(tile, b.height - b.by * tile), min(tile, b.width - b.bx * tile)
                image = np.frombuffer(b.data).reshape(tile, tile)[:h, :w]
                out = []
                for py in range((b.by - 1) // 2, (b.by + 1) // 2 + 1):
                    for px in range((b.bx - 1) // 2, (b.bx + 1) // 2 + 1):
                        if not (0 <= 2 * py * tile < b.height and 0 <= 2 * px * tile < b.width):
                            continue
                        top, left = 2 * py * tile - 1, 2 * px * tile - 1  # of the canvas with its halo
                        r0, r1 = max(top - b.by * tile, 0), min(top + 2 * tile + 2 - b.by * tile, h)
                        c0, c1 = max(left - b.bx * tile, 0), min(left + 2 * tile + 2 - b.bx * tile, w)
                        if r0 < r1 and c0 < c1:
                            out.append((b.path, b.level, b.band, py, px, b.width, b.height, b.by * tile + r0 - top, b.bx * tile + c0 - left, c1 - c0, image[r0:r1, c0:c1].tobytes()))
                yield pd.DataFrame(out, columns=["path", "level", "band", "by", "bx", "width", "height", "r", "c", "wide", "data"])

    def made(group: pd.DataFrame) -> pd.DataFrame:
        head = group.iloc[0]
        canvas = np.full((2 * tile + 2, 2 * tile + 2), np.nan)
        for r, c, wide, data in zip(group["r"], group["c"], group["wide"], group["data"], strict=True):
            piece = np.frombuffer(data).reshape(-1, wide)
            canvas[r : r + len(piece), c : c + wide] = piece
        width, height = -(-head.width // 2), -(-head.height // 2)
        small = np.full((tile, tile), np.nan)
        part = halved(canvas, resampling)[: height - head.by * tile, : width - head.bx * tile]
        small[: part.shape[0], : part.shape[1]] = part
        return pd.DataFrame([(head.path, head.level + 1, head.band, head.by, head.bx, width, height, small.tobytes())], columns=[c.split()[0] for c in BLOCKS.split(", ")])

    pieces = blocks.mapInPandas(sent, "path string, level int, band int, by int, bx int, width long, height long, r long, c long, wide long, data binary")
    return pieces.groupBy("path", "band", "by", "bx").applyInPandas(made, BLOCKS)


def pyramid(blocks: DataFrame, tile: int, resampling: str = "bilinear") -> DataFrame:
    """blocks and all levels above them, until a file is one block; rounds grow with the logarithm of the largest file."""
    below = kept(blocks, "blocks")
    found = below
    for _ in range(64):
        rest = below.where((F.col("width") > tile) | (F.col("height") > tile))
        if rest.isEmpty():
            break
        below = kept(overview(rest, tile, resampling), "overview")
        found = found.unionByName(below)
    return found
