"""Spatial and temporal joins of detections and track points.

Range joins are equi-joins on grid cells: one side is listed under its own cell, the
other under that cell and its neighbours, so no pair of far rows is ever made and
frames of any size spread over tasks by cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from voxtrail.session import pin

RINGS = 16
#: Distances that `reduce_within` holds at once: 2 MB of them, which stay near the processor.
PAIRS = 1 << 18


def distance(a: str, b: str, dims: list[str]) -> Column:
    """Euclidean distance of the columns `a.dim` and `b.dim`."""
    return F.sqrt(reduce(lambda s, d: s + d, [(F.col(f"{a}.{d}") - F.col(f"{b}.{d}")) * (F.col(f"{a}.{d}") - F.col(f"{b}.{d}")) for d in dims]))


def _cell(dims: list[str], size: float, name: str) -> Column:
    return F.struct(*[F.floor(F.col(f"{name}.{d}") / size).alias(d) for d in dims])


def _in_cells(left: DataFrame, right: DataFrame, keys: list[str], radius: float, dims: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of left as `a` under their own cell, and of right as `b` under that and its neighbours; both with `keys` and `__cell`."""
    a = left.select(F.struct("*").alias("a"))
    b = right.select(F.struct("*").alias("b"))
    steps = reduce(lambda acc, d: [(*s, o) for s in acc for o in (-1, 0, 1)], dims, [()])
    around = F.array(*[F.struct(*[(F.floor(F.col(f"b.{d}") / radius) + o).alias(d) for d, o in zip(dims, step)]) for step in steps])
    a = a.select("a", *[F.col(f"a.{k}").alias(k) for k in keys], _cell(dims, radius, "a").alias("__cell"))
    return a, b.select("b", *[F.col(f"b.{k}").alias(k) for k in keys], F.explode(around).alias("__cell"))


def within(left: DataFrame, right: DataFrame, keys: list[str], radius: float, dims: list[str]) -> DataFrame:
    """Structs a (of left), b (of right) and `d`, for rows equal in `keys` at most `radius` apart over `dims`.

    Spark takes the listed side for as small as it was before it was listed, and would send it whole through the driver; so both sides are shuffled.
    """
    a, b = _in_cells(left, right, keys, radius, dims)
    return a.join(b.hint("merge"), [*keys, "__cell"]).select("a", "b", distance("a", "b", dims).alias("d")).filter(F.col("d") <= radius)


def reduce_within(left: DataFrame, right: DataFrame, keys: list[str], radius: float, dims: list[str], work: Callable[[pd.DataFrame, pd.DataFrame, Iterator[tuple[slice, np.ndarray]]], pd.DataFrame], schema: str) -> DataFrame:
    """Rows of `schema` that `work` makes of the left rows of a cell, all right rows of the cells around, and blocks (left rows, distances to all right rows).

    Every left row is met once, with all right rows that may be within `radius` (and farther ones); the pairs of a crowd are arrays of
    about PAIRS distances, so none is ever written, sorted or sent.
    """

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        step = max(1, PAIRS // max(1, len(b)))
        places = [(a[d].to_numpy(np.float64), b[d].to_numpy(np.float64)) for d in dims]
        cuts = [slice(i, i + step) for i in range(0, len(a) if len(b) else 0, step)]
        return work(a, b, ((at, np.sqrt(reduce(np.add, [np.subtract.outer(x[at], y) ** 2 for x, y in places]))) for at in cuts))

    by, sides = [*keys, *[f"__{d}" for d in dims]], []
    for cells, name, of in zip(_in_cells(left, right, keys, radius, dims), "ab", (left, right)):
        rows = cells.select(*keys, *[F.col(f"__cell.{d}").alias(f"__{d}") for d in dims], *[F.col(f"{name}.{c}").alias(c) for c in of.columns if c not in keys])
        sides.append(rows.dropna(subset=by).groupBy(*by))
    return sides[0].cogroup(sides[1]).applyInPandas(meet, schema)


def nearest(left: DataFrame, right: DataFrame, keys: list[str], radius: float, dims: list[str], left_id: list[str], right_id: str, where: str = "true") -> DataFrame:
    """For each left row the nearest right row within `radius` for which `where` (of a and b) holds; ties go to the smaller `right_id`.

    Most rows have one nearby, so the search begins at a RINGS-th of the radius, with small cells.  What it finds is written
    once, beside the rows that have none there; only these, if there are any, go on to the whole radius.
    """
    close = _nearest(left, right, keys, radius / RINGS, dims, left_id, right_id, where)
    none = left.select(*left_id, F.lit(None).cast(close.schema["b"].dataType).alias("b"), F.lit(None).cast("double").alias("d"))
    marked = pin(close.unionByName(none).groupBy(*left_id).agg(F.first(F.when(F.col("d").isNotNull(), F.struct("b", "d")), ignorenulls=True).alias("m")))
    found, rest = marked.filter("m is not null").select(*left_id, "m.b", "m.d"), marked.filter("m is null").select(*left_id)
    if rest.isEmpty():
        return found
    return found.unionByName(_nearest(left.join(rest, left_id, "left_semi"), right, keys, radius, dims, left_id, right_id, where))


def _nearest(left: DataFrame, right: DataFrame, keys: list[str], radius: float, dims: list[str], left_id: list[str], right_id: str, where: str) -> DataFrame:
    pairs = within(left, right, keys, radius, dims).filter(where)
    best = pairs.groupBy(*[F.col(f"a.{c}").alias(c) for c in left_id]).agg(F.min_by(F.struct("b", "d"), F.struct("d", F.col(f"b.{right_id}"))).alias("m"))
    return best.select(*left_id, "m.b", "m.d")


def nearest_distance(points: DataFrame, keys: list[str], ids: list[str], dims: list[str], start: float, apart: float = 0.0) -> DataFrame:
    """Distance `d` of each row to the nearest other one equal in `keys` that is more than `apart` away; rows without one are left out.

    The search widens fourfold from `start` for the rows that have found none, up to the extent of all rows.
    """
    ends = points.agg(*[f(d) for d in dims for f in (F.min, F.max)]).first()
    extent = sum((ends[2 * i + 1] - ends[2 * i]) ** 2 for i in range(len(dims)) if ends[2 * i] is not None) ** 0.5
    rest, found = points, []
    while True:
        near = within(rest, points, keys, start, dims).filter(F.col("d") > apart)
        found.append(pin(near.groupBy(*[F.col(f"a.{i}").alias(i) for i in ids]).agg(F.min("d").alias("d"))))
        rest = pin(rest.join(found[-1].select(*ids), ids, "left_anti"))
        if start >= extent or rest.isEmpty():
            return reduce(lambda a, b: a.unionByName(b), found)
        start *= 4


def within_box(left: DataFrame, right: DataFrame, keys: list[str], half: float, dims: list[str]) -> DataFrame:
    """Pairs equal in `keys` and at most `half` apart in every one of `dims`, with structs a and b."""
    reach = half * len(dims) ** 0.5
    pairs = within(left, right, keys, reach * (1 + 1e-9), dims)
    return pairs.filter(reduce(lambda s, c: s & c, [F.abs(F.col(f"a.{d}") - F.col(f"b.{d}")) <= half for d in dims]))


def gap_pairs(ends: DataFrame, starts: DataFrame, keys: list[str], end: str, start: str, gap: int) -> DataFrame:
    """Interval join: rows whose `start` is 1 to `gap` after `end`; each end is listed for its `gap` next frames."""
    listed = ends.select(F.struct("*").alias("tail"), *keys, F.explode(F.transform(F.sequence(F.lit(1), F.lit(gap)), lambda g: F.col(end) + g)).alias("__at"))
    heads = starts.select(F.struct("*").alias("head"), *keys, F.col(start).alias("__at"))
    return listed.hint("merge").join(heads, [*keys, "__at"]).select("tail", "head", (F.col(f"head.{start}") - F.col(f"tail.{end}")).alias("gap"))


def lookup(left: DataFrame, right: DataFrame, keys: list[str], value: str, default) -> DataFrame:
    """Left join on `keys` with `default` where nothing is found."""
    return left.join(right.select(*keys, value), keys, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def nearest_centre(frames: DataFrame, centres: DataFrame, keys: list[str], t: str, centre: str) -> DataFrame:
    """As-of join: the centre nearest in time to each frame, the earlier one on ties.

    Both sides are laid in one line by time; each frame sees the last centre before and the
    first after it, so nothing is compared pair by pair.
    """
    f = frames.select(*keys, F.col(t).alias("__t"), F.lit(1).alias("__k"), F.struct("*").alias("__row"), F.lit(None).cast("long").alias("__c"))
    c = centres.select(*keys, F.col(centre).alias("__t"), F.lit(0).alias("__k"), F.lit(None).cast(f.schema["__row"].dataType).alias("__row"), F.col(centre).cast("long").alias("__c"))
    w = Window.partitionBy(*keys).orderBy("__t", "__k")
    line = f.unionByName(c).withColumn("__lo", F.last("__c", True).over(w)).withColumn("__hi", F.first("__c", True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    at = F.when(F.col("__hi").isNull() | (F.col("__t") - F.col("__lo") <= F.col("__hi") - F.col("__t")), F.col("__lo")).otherwise(F.col("__hi"))
    return line.filter("__k = 1").select("__row.*", at.alias(centre))


def merge_defaults(left: DataFrame, right: DataFrame, keys: list[str], defaults: dict[str, object]) -> DataFrame:
    """Full outer join with `defaults` for what a side lacks."""
    out = left.join(right, keys, "full_outer")
    return out.select(*keys, *[F.coalesce(c, F.lit(v)).alias(c) for c, v in defaults.items()])
