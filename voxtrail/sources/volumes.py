"""Pixel and label rows: small .npy volumes read whole, plane rows and pyramids (files of any size: sources.arrays)."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

AXES = ("t", "z", "y", "x")


def read_npy(spark: SparkSession, path: str, value: str = "label") -> DataFrame:
    """Non-zero voxels of all [t, z, y, x] .npy files under `path`; Spark reads the files, so any store will do."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def rows(batches):
        for batch in batches:
            for name, data in zip(batch.path, batch.content):
                a = np.load(io.BytesIO(data), allow_pickle=False)
                a = a.reshape((1,) * (4 - a.ndim) + a.shape)
                at = np.nonzero(a)
                out = pd.DataFrame(dict(zip(AXES, map(lambda i: i.astype("int32"), at))))
                out.insert(0, "movie", name.rsplit("/", 1)[-1].removesuffix(".npy"))
                yield out.assign(**{value: a[at].astype("int32")})

    return files.mapInPandas(rows, f"movie string, t int, z int, y int, x int, {value} int")


def to_planes(pixels: DataFrame, value: str = "v") -> DataFrame:
    """One row for each plane with its pixels as a list, for storage in tiles."""
    return pixels.groupBy("movie", "t", "z").agg(F.array_sort(F.collect_list(F.struct("y", "x", value))).alias("pixels"))


def from_planes(planes: DataFrame) -> DataFrame:
    """Pixel rows of plane rows."""
    return planes.select("movie", "t", "z", F.explode("pixels").alias("p")).select("movie", "t", "z", "p.*")


def pyramid(planes: DataFrame, levels: int) -> DataFrame:
    """Planes (…, y, x, v) at `levels` resolutions: `level` 0 as they are, each further one by means of 2 x 2 pixels of the one before's grid."""
    keys = [c for c in planes.columns if c not in ("y", "x", "v")]
    listed = planes.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    size = F.pow(F.lit(2.0), F.col("level"))
    at = [F.floor(F.col(c) / size).cast("int").alias(c) for c in ("y", "x")]
    return listed.select(*keys, "level", *at, "v").groupBy(*keys, "level", "y", "x").agg(F.avg("v").alias("v"))


def level(pyramid: DataFrame, number: int) -> DataFrame:
    """One resolution of a pyramid."""
    return pyramid.filter(F.col("level") == number).drop("level")


def slice_volume(pixels: DataFrame, t: tuple[int, int] | None = None, z: tuple[int, int] | None = None, channels: list[int] | None = None) -> DataFrame:
    """Rows of some frames, slices and channels; the conditions reach the scan."""
    out = pixels
    for column, bounds in (("t", t), ("z", z)):
        if bounds:
            out = out.filter(F.col(column).between(*bounds))
    return out.filter(F.col("c").isin(channels)) if channels is not None else out
