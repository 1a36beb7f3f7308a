"""Tiling of planes with overlap and taper-weighted averaging of tiles, as joins and sums.

The model that works on tiles is the caller's; this is the plan around it.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from voxtrail.operators.motion import normalise_range

SIZE, OVERLAP, TAPER = 224, 0.1, 7.5


def padding(length: int, multiple: int = 16, extra: int = 1) -> tuple[int, int]:
    """Pixels before and after a side so that it divides by `multiple`, with half of `extra` units on either side."""
    whole = math.ceil(length / multiple) * multiple - length
    total = extra * multiple + whole
    return total - total // 2, total // 2


def starts(length: int, size: int = SIZE, overlap: float = OVERLAP) -> list[int]:
    """Where tiles begin along a side, evenly from 0 to the last place that fits."""
    if length <= size:
        return [0]
    n = math.ceil((1 + 2 * overlap) * length / size)
    return [int(i * (length - size) / (n - 1)) for i in range(n)]


def tile(pixels: DataFrame, height: int, width: int, size: int = SIZE, overlap: float = OVERLAP) -> DataFrame:
    """Rows of every tile that a pixel is in: a range join to a table of tiles, whose number depends on the plane's size only."""
    rows = [(i, y, x) for i, (y, x) in enumerate((y, x) for y in starts(height, size, overlap) for x in starts(width, size, overlap))]
    spec = F.array(*[F.struct(F.lit(i).alias("tile"), F.lit(y).alias("ty"), F.lit(x).alias("tx")) for i, y, x in rows])
    inside = F.filter(spec, lambda s: F.col("y").between(s["ty"], s["ty"] + size - 1) & F.col("x").between(s["tx"], s["tx"] + size - 1))
    listed = pixels.select("*", F.explode(inside).alias("s"))
    return listed.select(*pixels.columns, F.col("s.tile").alias("tile"), (F.col("y") - F.col("s.ty")).alias("dy"), (F.col("x") - F.col("s.tx")).alias("dx"))


def taper(offset: Column, size: int, sigma: float = TAPER) -> Column:
    """Weight of a place along a tile's side: near 1 inside, falling towards the ends."""
    away = F.abs(offset - (size - 1) / 2)
    return 1 / (1 + F.exp((away - (size / 2 - 20)) / sigma))


def average(tiles: DataFrame, value: str, size: int = SIZE) -> DataFrame:
    """One value for each pixel: its tiles' values weighted by their tapers."""
    w = taper(F.col("dy"), size) * taper(F.col("dx"), size)
    return tiles.groupBy("movie", "t", "z", "y", "x").agg((F.sum(F.col(value) * w) / F.sum(w)).alias(value))


def restore(pixels: DataFrame, model: Callable[[DataFrame], DataFrame], height: int, width: int, size: int = SIZE, overlap: float = OVERLAP, normalise: bool = True) -> DataFrame:
    """A restoration of every plane (movie, t, z, y, x, v): scaled by its percentiles, padded with zeros, tiled, put through `model`, averaged and cropped.

    `model` gets rows of tiles (with tile, dy, dx and v) and gives them with new v.  A plane of one value is not scaled.
    """
    plane = ["movie", "t", "z"]
    if normalise:
        flat = pixels.groupBy(*plane).agg((F.max("v") == F.min("v")).alias("__flat"))
        scaled = normalise_range(pixels.withColumn("__raw", F.col("v")), plane, "v").join(flat, plane)
        pixels = scaled.withColumn("v", F.when(F.col("__flat"), F.col("__raw")).otherwise(F.col("v"))).select(*plane, "y", "x", "v")
    (top, bottom), (left, right) = padding(height), padding(width)
    high, wide = height + top + bottom, width + left + right
    inside = pixels.select(*plane, (F.col("y") + top).alias("y"), (F.col("x") + left).alias("x"), F.col("v").cast("double").alias("v"))
    at = F.explode(F.sequence(F.lit(0), F.lit(high * wide - 1)))
    every = pixels.select(*plane).distinct().select(*plane, at.alias("k")).select(*plane, F.floor(F.col("k") / wide).cast("int").alias("y"), (F.col("k") % wide).alias("x"))
    border = every.filter(~(F.col("y").between(top, top + height - 1) & F.col("x").between(left, left + width - 1))).withColumn("v", F.lit(0.0))
    done = average(model(tile(inside.unionByName(border), high, wide, size, overlap)), "v", size)
    y, x = F.col("y") - top, F.col("x") - left
    return done.filter(y.between(0, height - 1) & x.between(0, width - 1)).select(*plane, y.alias("y"), x.alias("x"), "v")
