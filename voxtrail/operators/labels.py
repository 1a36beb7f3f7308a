"""Algebra of label maps: sizes, centroids, intensities, colours, overlaps and purity.

Voxels are sparse rows (movie, t, z, y, x, label, channels); label 0 is background and
takes no part.  Counts are 64-bit, so no overlap wraps.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from voxtrail.functions.windows import quantiles

CELL = ["movie", "t", "label"]


def foreground(voxels: DataFrame) -> DataFrame:
    return voxels.filter("label > 0")


def filter_small(voxels: DataFrame, min_voxels: int = 200, keys: list[str] = CELL) -> DataFrame:
    """Drops labels of fewer than `min_voxels` voxels, one by one for each frame."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return foreground(voxels).withColumn("__n", n).filter(F.col("__n") >= min_voxels).drop("__n")


def filter_small_projected(voxels: DataFrame, min_pixels: int) -> DataFrame:
    """Drops labels that cover fewer than `min_pixels` pixels of the greatest-label projection along z."""
    top = foreground(voxels).groupBy("movie", "t", "y", "x").agg(F.max("label").alias("label"))
    small = top.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < min_pixels)
    return foreground(voxels).join(small.select(*CELL), CELL, "left_anti")


def reindex(voxels: DataFrame, min_size: int = 20, plane: list[str] = ["movie", "t", "z"]) -> DataFrame:
    """Drops small labels of each plane and numbers the others 1, 2 and so on in their order."""
    kept = filter_small(voxels, min_size, [*plane, "label"])
    numbers = kept.select(*plane, "label").distinct().withColumn("new_label", F.row_number().over(Window.partitionBy(*plane).orderBy("label")))
    return kept.join(numbers, [*plane, "label"])


def centroids(voxels: DataFrame) -> DataFrame:
    """Mean place and voxel count of every cell."""
    return foreground(voxels).groupBy(*CELL).agg(F.avg("z").alias("cz"), F.avg("y").alias("cy"), F.avg("x").alias("cx"), F.count(F.lit(1)).alias("n_vox"))


def intensities(voxels: DataFrame, channels: list[str]) -> DataFrame:
    """Mean of each channel over every cell."""
    return foreground(voxels).groupBy(*CELL).agg(*[F.avg(c).alias(f"mean_{c}") for c in channels])


def sample_channels(voxels: DataFrame, pixels: DataFrame) -> DataFrame:
    """Mean value of each (cell, channel), for pixels in a table of their own: an equi-join on the voxel."""
    at = ["movie", "t", "z", "y", "x"]
    return foreground(voxels).select(*at, "label").join(pixels, at).groupBy(*CELL, "c").agg(F.avg("v").alias("mean_v"), F.count(F.lit(1)).alias("n"))


def dominant_channel(cells: DataFrame, channels: list[str], dim_quantile: float = 0.1) -> DataFrame:
    """Channel of greatest mean, the first on ties; -1 where that mean is at or below its quantile over the movie's cells."""
    greatest = F.greatest(*[F.col(f"mean_{c}") for c in channels])
    which = reduce(lambda out, i: F.when(F.col(f"mean_{channels[i]}") == F.col("greatest"), i).otherwise(out), reversed(range(len(channels))), F.lit(None).cast("int"))
    cells = cells.withColumn("greatest", greatest)
    cut = quantiles(cells, "greatest", ["movie"], [dim_quantile]).select("movie", F.col("__p")[0].alias("cut"))
    return cells.join(cut, "movie").select(*CELL, F.when(F.col("greatest") <= F.col("cut"), -1).otherwise(which).alias("color_id"), "greatest")


def overlaps(pairs: DataFrame) -> DataFrame:
    """Pixels in each pair of labels (a, b), background included."""
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def jaccard(overlap: DataFrame) -> DataFrame:
    """Overlap over union for every pair of foreground labels; marginals count background pixels too."""
    na = F.sum("n").over(Window.partitionBy("a"))
    nb = F.sum("n").over(Window.partitionBy("b"))
    return overlap.withColumn("size_a", na).withColumn("size_b", nb).filter("a > 0 and b > 0").withColumn("iou", F.col("n") / (F.col("size_a") + F.col("size_b") - F.col("n")))


def slice_overlaps(voxels: DataFrame, skip: int = 1) -> DataFrame:
    """Overlaps of labels in slices z and z + skip of one frame, with sizes and the Jaccard index."""
    v = foreground(voxels).select("movie", "t", "z", "y", "x", "label")
    sizes = v.groupBy("movie", "t", "z", "label").agg(F.count(F.lit(1)).alias("size"))
    # Rows of a pixel with one label are counted before they are paired.
    v = v.groupBy("movie", "t", "z", "y", "x", "label").agg(F.count(F.lit(1)).alias("k"))
    above = v.select("movie", "t", (F.col("z") - skip).alias("z"), "y", "x", F.col("label").alias("label_up"), F.col("k").alias("k_up"))
    n = v.join(above, ["movie", "t", "z", "y", "x"]).groupBy("movie", "t", "z", "label", "label_up").agg(F.sum(F.col("k") * F.col("k_up")).alias("n"))
    up = sizes.select("movie", "t", (F.col("z") - skip).alias("z"), F.col("label").alias("label_up"), F.col("size").alias("size_up"))
    out = n.join(sizes, ["movie", "t", "z", "label"]).join(up, ["movie", "t", "z", "label_up"])
    return out.withColumn("iou", F.col("n") / (F.col("size") + F.col("size_up") - F.col("n")))


def classify(voxels: DataFrame, channels: list[str], min_size: int = 100, purity: float = 0.7) -> DataFrame:
    """good, merged or fragmented for each cell, by size and by its channels' shares after division by the frame's means.

    A frame's means are over all its pixels, background included.
    """
    means = voxels.groupBy("movie", "t").agg(*[F.avg(c).alias(f"frame_{c}") for c in channels])
    cells = foreground(voxels).groupBy(*CELL).agg(F.count(F.lit(1)).alias("size"), *[F.avg(c).alias(f"mean_{c}") for c in channels]).join(means, ["movie", "t"])
    share = [F.col(f"mean_{c}") / (F.col(f"frame_{c}") + 1e-6) for c in channels]
    cells = cells.withColumn("total", reduce(lambda a, b: a + b, share)).withColumn("purity", F.greatest(*share) / F.col("total"))
    kind = F.when((F.col("size") < min_size) | (F.col("total") < 1e-6), "fragmented").when(F.col("purity") >= purity, "good").otherwise("merged")
    return cells.select(*CELL, "size", "purity", kind.alias("kind"))


def purity_score(cells: DataFrame, count_penalty: float = 0.0) -> DataFrame:
    """Score of each frame that has cells: good over large ones, less a penalty for each cell."""
    n = lambda kind: F.sum((F.col("kind") == kind).cast("bigint")).alias(f"n_{kind}")
    per = cells.groupBy("movie", "t").agg(n("good"), n("merged"), n("fragmented"))
    large = F.col("n_good") + F.col("n_merged")
    return per.withColumn("score", F.when(large > 0, F.col("n_good") / large).otherwise(0.0) - count_penalty * (large + F.col("n_fragmented")))


def mean_field(voxels: DataFrame, field: DataFrame, values: list[str]) -> DataFrame:
    """Voxel-weighted mean of field values over each cell: an equi-join on the voxel."""
    at = ["movie", "t", "z", "y", "x"]
    return foreground(voxels).select(*at, "label").join(field, at).groupBy(*CELL).agg(*[F.avg(v).alias(v) for v in values])


def dense_mean_field(voxels: DataFrame, field: DataFrame, values: list[str]) -> DataFrame:
    """Field values averaged over the slices of a frame that hold any label."""
    slices = foreground(voxels).select("movie", "t", "z").distinct()
    return field.join(slices, ["movie", "t", "z"], "left_semi").groupBy("movie", "t", "y", "x").agg(*[F.avg(v).alias(v) for v in values])


def last_slices(voxels: DataFrame) -> DataFrame:
    """The last slice of every label in its frame, and how many labels end there."""
    last = foreground(voxels).groupBy(*CELL).agg(F.max("z").alias("last_z"))
    return last.groupBy("movie", "t", "last_z").agg(F.count(F.lit(1)).alias("n_labels"))


def contacts(voxels: DataFrame) -> DataFrame:
    """For each pair of labels of a plane, the pixels of b that are 4-neighbours of a."""
    at = ["movie", "t", "z", "y", "x"]
    own = foreground(voxels).groupBy(*at).agg(F.collect_set("label").alias("labels"))
    # The labels around a pixel are gathered before they are paired with its own, so a pair is met once for each pixel, and only counts are sent on.
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    near = own.select("movie", "t", "z", F.explode(steps).alias("s"), "y", "x", "labels").select("movie", "t", "z", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), "labels")
    around = near.groupBy(*at).agg(F.array_distinct(F.flatten(F.collect_list("labels"))).alias("around"))
    met = around.join(own, at).select("movie", "t", "z", F.explode("around").alias("a"), "labels").select("movie", "t", "z", "a", F.explode("labels").alias("b"))
    return met.filter("a <> b").groupBy("movie", "t", "z", "a", "b").agg(F.count(F.lit(1)).alias("n_contact"))


def frame_counts(cells: DataFrame, label: str = "label") -> DataFrame:
    """Cells in each frame."""
    return cells.groupBy("movie", "t").agg(F.countDistinct(label).alias("num_cells"))


def count_before_after(voxels: DataFrame, min_voxels: int) -> DataFrame:
    """Cells of each frame before and after the size filter."""
    n = foreground(voxels).groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("movie", "t").agg(F.count(F.lit(1)).alias("n_before"), F.sum((F.col("n") >= min_voxels).cast("bigint")).alias("n_after"))


def shape_moments(voxels: DataFrame) -> DataFrame:
    """Area, box, extent, axes, eccentricity and equivalent diameter of each cell's projection along z.

    Second moments of the pixels, each taken as a square of side 1, give the ellipse of equal moments.
    """
    p = foreground(voxels).select(*CELL, "y", "x").distinct()
    m = p.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("area"),
        (F.max("y") - F.min("y") + 1).alias("height"),
        (F.max("x") - F.min("x") + 1).alias("width"),
        (F.avg(F.col("y") * F.col("y")) - F.avg("y") * F.avg("y") + 1 / 12).alias("myy"),
        (F.avg(F.col("x") * F.col("x")) - F.avg("x") * F.avg("x") + 1 / 12).alias("mxx"),
        (F.avg(F.col("y") * F.col("x")) - F.avg("y") * F.avg("x")).alias("mxy"),
    )
    root = F.sqrt((F.col("mxx") - F.col("myy")) * (F.col("mxx") - F.col("myy")) + 4 * F.col("mxy") * F.col("mxy"))
    m = m.withColumn("l1", (F.col("mxx") + F.col("myy") + root) / 2).withColumn("l2", F.greatest((F.col("mxx") + F.col("myy") - root) / 2, F.lit(0.0)))
    return m.select(
        *CELL,
        "area",
        (F.col("area") / (F.col("height") * F.col("width"))).alias("extent"),
        (4 * F.sqrt("l1")).alias("axis_major"),
        (4 * F.sqrt("l2")).alias("axis_minor"),
        F.sqrt(1 - F.col("l2") / F.col("l1")).alias("eccentricity"),
        F.sqrt(4 * F.col("area") / F.lit(3.141592653589793)).alias("equivalent_diameter"),
        (F.sqrt("l1") / F.greatest(F.sqrt("l2"), F.lit(1e-9))).alias("aspect_ratio"),
    )
