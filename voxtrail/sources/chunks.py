"""A pyramid of pixels in chunks, kept in Parquet: a slice reads its own chunks only.

A row is a chunk: the pixels of one plane in one square of `side` pixels at one level.  Files are partitioned by level
and frame and sorted by slice, channel and square, so frames and levels are chosen by folder, the rest by the statistics of
Parquet's row groups.  Everything is written and read by Spark.

Defined cases: pixels that are missing stay missing, at a coarser level the mean is of those that are there; a null place
or frame is an error of the input and is left out; an empty table makes an empty store; further columns are left out; writing
anew replaces the frames that are written and leaves others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from voxtrail.sources.volumes import pyramid

STORE = "movie string, z int, c int, cy int, cx int, n int, pixels array<struct<y:int,x:int,v:double>>, level int, t int"


def write(pixels: DataFrame, path: str, levels: int = 1, side: int = 64) -> None:
    """Chunks of pixels (movie, t, z, c, y, x, v) at `levels` resolutions."""
    planes = pixels.select("movie", *[F.col(k).cast("int").alias(k) for k in ("t", "z", "c", "y", "x")], F.col("v").cast("double").alias("v")).dropna(subset=["t", "y", "x"])
    square = [F.floor(F.col(a) / side).cast("int").alias(f"c{a}") for a in ("y", "x")]
    rows = pyramid(planes, levels).select("movie", "level", "t", "z", "c", *square, F.struct("y", "x", "v").alias("p"))
    chunks = rows.groupBy("movie", "level", "t", "z", "c", "cy", "cx").agg(F.array_sort(F.collect_list("p")).alias("pixels"))
    out = chunks.select("movie", "z", "c", "cy", "cx", F.size("pixels").alias("n"), "pixels", "level", "t").repartition("level", "t").sortWithinPartitions("level", "t", "movie", "z", "c", "cy", "cx")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("level", "t").parquet(path)


def chunks(spark: SparkSession, path: str, side: int = 64, level: int = 0, channels: list[int] | None = None, **bounds: tuple[int, int]) -> DataFrame:
    """The chunks that hold pixels within half-open `bounds` of t, z, y and x, in pixels of the level."""
    out = spark.read.schema(STORE).parquet(path).filter(F.col("level") == level)
    for axis, (low, high) in bounds.items():
        out = out.filter(F.col(axis).between(low, high - 1)) if axis in ("t", "z") else out.filter(F.col(f"c{axis}").between(low // side, (high - 1) // side))
    return out if channels is None else out.filter(F.col("c").isin(channels))


def read(spark: SparkSession, path: str, side: int = 64, level: int = 0, channels: list[int] | None = None, **bounds: tuple[int, int]) -> DataFrame:
    """Pixels within `bounds`, from their chunks."""
    out = chunks(spark, path, side, level, channels, **bounds).select("movie", "t", "z", "c", F.explode("pixels").alias("p")).select("movie", "t", "z", "c", "p.*")
    for axis in ("y", "x"):
        if axis in bounds:
            out = out.filter(F.col(axis).between(bounds[axis][0], bounds[axis][1] - 1))
    return out
