"""Nearest neighbours without a radius, by cells that follow the density of places.

The right side is counted in a tree of cells: each level cuts a cell into 2 ** BITS parts along every
dimension.  A node has the number of its rows and the box around them; one of at most LEAF rows has the rows
themselves, so a crowded place is split and an empty one stays wide.  The left side goes down the
tree level by level, all rows at once, in equi-joins of open nodes with their children.  A node stays
open while its box is no farther than what is certain for the row: the nearest row seen, or the far corner of a box.
So rows are compared only in cells that may hold the answer, whatever the density and however far the answer.

What is certain for a row at first is the nearest of some right rows beside it in the order of a curve through the cells
(`beside`).  Most rows then need not begin at the root but in the few cells of a middle level that their answer may lie in.

Of rows at one place the two of smallest ids take part: no other can be an answer, and a crowd at one place costs nothing.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from voxtrail.session import pin

BITS = 2
LEAF = 8
MAX_LEVELS = 12
#: Right rows that an average cell has where rows are put on the curve, rows of the curve looked at on either side, cells in which a row may begin.
CURVE_ROWS = 64
ASIDE = 6
FIRST_CELLS = 8


def _squares(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [p * p for p in parts])


def _boxes(dims: list[str], low: str = "{}", high: str = "{}") -> list[Column]:
    return [c for d in dims for c in (F.min(low.format(d)).alias(f"lo_{d}"), F.max(high.format(d)).alias(f"hi_{d}"))]


def cell_tree(rows: DataFrame, keys: list[str], dims: list[str], levels: int) -> list[DataFrame]:
    """Nodes (keys, cell, n, lo_ and hi_ of each dimension, rows) of levels 0 to `levels`, of rows (keys, cell, id, dims) placed in the finest cells."""
    counted = pin(rows.groupBy(*keys, "cell").agg(F.count(F.lit(1)).alias("n"), *_boxes(dims)))
    few = rows.join(counted.filter(F.col("n") <= LEAF).select(*keys, "cell"), [*keys, "cell"], "left_semi")
    few = few.groupBy(*keys, "cell").agg(F.collect_list(F.struct("id", *dims)).alias("rows"))
    nodes = [pin(counted.join(few, [*keys, "cell"], "left"))]
    for _ in range(levels):
        above = F.transform("cell", lambda c: F.shiftright(c, BITS)).alias("cell")
        # children of too many rows list none, and then their parent has too many as well
        listed = F.when(F.sum("n") <= LEAF, F.flatten(F.collect_list("rows"))).alias("rows")
        nodes.append(pin(nodes[-1].groupBy(*keys, above).agg(F.sum("n").alias("n"), *_boxes(dims, "lo_{}", "hi_{}"), listed)))
    return nodes[::-1]


def beside(left: DataFrame, right: DataFrame, keys: list[str], dims: list[str], levels: int, coarse: int) -> DataFrame:
    """`left` (keys, cell, but, p) with `bound`, the least squared distance to the right rows (keys, cell, id, dims) among the ASIDE rows on either side; infinite without one.

    Both sides are in order along a Z curve through the finest cells, within each cell of level `coarse`.
    """
    bits, used = BITS * levels, min(BITS * levels, 62 // len(dims))
    # The first `used` bits of all dimensions in turn
    curve = reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(F.shiftright(F.col("cell")[i], bits - 1 - n).bitwiseAND(F.lit(1).cast("long")), (used - 1 - n) * len(dims) + i) for n in range(used) for i in range(len(dims))])
    at = [F.transform("cell", lambda c: F.shiftright(c, BITS * (levels - coarse))).alias("__at"), curve.alias("__curve")]
    row = F.struct("id", *dims).alias("__row")
    both = left.select("*", *at, F.lit(None).cast(right.select(row).schema[0].dataType).alias("__row")).unionByName(right.select(*keys, *at, row), allowMissingColumns=True)
    near = both.withColumn("__near", F.collect_list("__row").over(Window.partitionBy(*keys, "__at").orderBy("__curve").rowsBetween(-ASIDE, ASIDE))).filter("__row is null")
    others = F.filter("__near", lambda r: ~r["id"].eqNullSafe(F.col("but")))
    apart = F.array_min(F.transform(others, lambda r: _squares([r[x] - F.col("p")[d] for x, d in zip(dims, left.schema["p"].dataType.names)])))
    return near.withColumn("bound", F.coalesce(apart, F.lit(float("inf")))).select(*left.columns, "bound")


def nearest_anywhere(left: DataFrame, right: DataFrame, keys: list[str], dims: list[str], left_id: list[str], right_id: str, but: str | None = None, levels: int | None = None) -> DataFrame:
    """`left_id`, the nearest right row's id as `nearest` and its distance `d`, among rows equal in `keys`; ties go to the smaller id.

    `left_id` is unique in `left` and `right_id` in each key of `right`; column `but` of `left` names the right row that is no
    answer (the row itself).  Rows with a null key, id or coordinate or one that is not a finite number take no part, and
    rows without an answer are left out; an empty side gives no rows; further columns are left out, whatever their names.
    The tree's depth follows the number of rows, up to MAX_LEVELS (`levels` sets it); what is still crowded at its end is joined cell by cell, exactly.
    """
    finite = lambda names: reduce(lambda a, b: a & b, [F.col(d).isNotNull() & (F.abs(F.col(d)) < float("inf")) for d in names])
    found = left.filter(finite(dims)).select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.struct(*left_id).alias("q"), F.struct(*[F.col(d).cast("double").alias(d) for d in dims]).alias("p"), (F.col(but) if but else F.lit(None)).alias("but"))
    rows = right.filter(finite(dims) & F.col(right_id).isNotNull()).select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(right_id).alias("id"), *[F.col(d).cast("double").alias(f"x{i}") for i, d in enumerate(dims)])
    xs, ks = [f"x{i}" for i in range(len(dims))], [f"k{i}" for i in range(len(keys))]
    id_type = rows.schema["id"].dataType
    ends = rows.agg(F.count(F.lit(1)).alias("n"), *_boxes(xs)).first()
    if not ends["n"]:
        return found.filter(F.lit(False)).select("q.*", F.lit(None).cast(id_type).alias("nearest"), F.lit(None).cast("double").alias("d"))
    if levels is None:
        levels = min(MAX_LEVELS, 2 + math.ceil(max(0.0, math.log(ends["n"] / LEAF, 2 ** (BITS * len(dims))))))
    step = (max(ends[f"hi_{x}"] - ends[f"lo_{x}"] for x in xs) or 1.0) / (1 << (BITS * levels))
    last = (1 << (BITS * levels)) - 1
    cell = F.array(*[F.least(F.floor((F.col(x) - ends[f"lo_{x}"]) / step).cast("long"), F.lit(last).cast("long")) for x in xs])
    rank = F.row_number().over(Window.partitionBy(*ks, *xs).orderBy("id"))
    rows = pin(rows.withColumn("rank", rank).filter("rank <= 2").select(*ks, "id", *xs, cell.alias("cell")))

    place = [F.col("p")[d] for d in dims]
    near = _squares([F.greatest(F.col(f"lo_{x}") - p, p - F.col(f"hi_{x}"), F.lit(0.0)) for x, p in zip(xs, place)])
    far = _squares([F.greatest(F.abs(F.col(f"lo_{x}") - p), F.abs(F.col(f"hi_{x}") - p)) for x, p in zip(xs, place)])
    apart = lambda r: _squares([r[x] - p for x, p in zip(xs, place)])
    others = F.filter("rows", lambda r: ~r["id"].eqNullSafe(F.col("but")))
    hit = F.array_min(F.transform(others, lambda r: F.struct(apart(r).alias("d2"), r["id"].alias("id"))))
    listed = F.col("rows").isNotNull()

    # The level whose cells have about CURVE_ROWS rows of a key; there rows begin whose bound reaches into few cells.
    many = ends["n"] / max(1, rows.select(*ks).distinct().count())
    first = max(0, min(levels - 1, math.floor(math.log(max(1.0, many / CURVE_ROWS), 2 ** (BITS * len(dims))))))
    width = step * (1 << (BITS * (levels - first)))
    on = lambda c, x, size, cells: F.greatest(F.lit(0).cast("long"), F.least(F.floor((c - ends[f"lo_{x}"]) / size).cast("long"), F.lit(cells - 1).cast("long")))
    placed = found.withColumn("cell", F.array(*[on(p, x, step, last + 1) for x, p in zip(xs, place)]))
    found = pin(beside(placed, rows, ks, xs, levels, first).drop("cell")) if levels else found.withColumn("bound", F.lit(float("inf")))
    # A little more than the bound, as cells and distances are rounded
    reach = F.sqrt("bound") * (1 + 1e-9) + step * 1e-6 + 1e-150
    ranges = [(on(p - reach, x, width, 1 << (BITS * first)), on(p + reach, x, width, 1 << (BITS * first))) for x, p in zip(xs, place)]
    cells = reduce(lambda a, b: a * b, [(b - a + 1).cast("double") for a, b in ranges])
    direct = (F.col("bound") < float("inf")) & (cells <= FIRST_CELLS) if levels else F.lit(False)
    begin = found.filter(direct)
    for i, (a, b) in enumerate(ranges):
        begin = begin.withColumn(f"c{i}", F.explode(F.sequence(a, b)))
    begin = begin.withColumn("above", F.array(*[f"c{i}" for i in range(len(xs))])).drop(*[f"c{i}" for i in range(len(xs))])
    answers, opened = [], found.filter(~direct)
    for level, nodes in enumerate(cell_tree(rows, ks, xs, levels)):
        if level == first + 1:
            opened = begin.unionByName(opened, allowMissingColumns=True)
        nodes = nodes.withColumn("above", F.transform("cell", lambda c: F.shiftright(c, BITS)))
        met = opened.join(nodes, [*ks, "above"] if level else ks).withColumn("near", near).filter(F.col("near") <= F.col("bound")).withColumn("hit", hit)
        sure = F.least("bound", F.when(listed, F.col("hit.d2")).otherwise(far))
        met = met.withColumn("bound", F.min(sure).over(Window.partitionBy("q"))).filter(F.col("near") <= F.col("bound"))
        met = pin(met.select(*ks, "q", "p", "but", "bound", F.col("cell").alias("above"), "hit", listed.alias("listed")))
        answers.append(met.filter("hit is not null").select("q", "hit"))
        opened = met.filter("not listed").drop("hit", "listed")
        if level > first and opened.isEmpty():
            break
    else:
        pairs = opened.withColumnRenamed("above", "cell").join(rows, [*ks, "cell"]).filter(~F.col("id").eqNullSafe(F.col("but")))
        answers.append(pairs.select("q", F.struct(_squares([F.col(x) - p for x, p in zip(xs, place)]).alias("d2"), "id").alias("hit")))
    best = reduce(lambda a, b: a.unionByName(b), answers).groupBy("q").agg(F.min("hit").alias("hit"))
    return best.select("q.*", F.col("hit.id").alias("nearest"), F.sqrt("hit.d2").alias("d"))
