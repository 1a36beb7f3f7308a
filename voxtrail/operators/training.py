"""What a segmenter's training reads: assembled pixels, splits, windowed repulsion; and tracks of other programs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from voxtrail.operators import vectors

AT = ["movie", "t", "z", "y", "x"]


def mixed(value: Column, seed: int = 0) -> Column:
    """A number below 2^32 that scatters integers, for draws that any engine repeats."""
    return F.pmod((value + seed + 1) * 2654435761, F.lit(1 << 32))


def shuffled_split(frames: DataFrame, ratio: float = 0.8, seed: int = 0) -> DataFrame:
    """Marks `ratio` of each movie's frames as training ones, in the order of a scatter of frame numbers."""
    w = Window.partitionBy("movie")
    i, n = F.row_number().over(w.orderBy(mixed(F.col("t"), seed), "t")), F.count(F.lit(1)).over(w)
    return frames.select("movie", "t").distinct().select("movie", "t", (i <= F.floor(n * ratio)).alias("is_train"))


def assemble(frames: DataFrame, temporal: DataFrame, variance: DataFrame, flow: DataFrame) -> DataFrame:
    """Each pixel's inputs: its intensity (the mean of its channels), then temporal and variance metrics in the order of their names.

    `next_inputs` are those of the same pixel one frame on, with the displacement (u, v) that leads there; both are
    null where a frame has no field or no next frame.
    """
    def named(metrics: DataFrame, out: str) -> DataFrame:
        rows = metrics.groupBy(*AT).agg(F.array_sort(F.collect_list(F.struct("name", "value"))).alias("m"))
        return rows.select(*AT, F.transform("m", lambda m: m["value"]).alias(out))

    none = F.array().cast("array<double>")
    base = frames.groupBy(*AT).agg(F.avg("v").alias("intensity")).join(named(temporal, "temporal"), AT, "left").join(named(variance, "variance"), AT, "left")
    base = base.select(*AT, F.concat(F.array("intensity"), F.coalesce("temporal", none), F.coalesce("variance", none)).alias("inputs"))
    step = flow.filter("scale = 1").select("movie", F.col("t0").alias("t"), "z", "y", "x", "u", "v")
    ahead = base.select("movie", (F.col("t") - 1).alias("t"), "z", "y", "x", F.col("inputs").alias("next_inputs"))
    moved = step.join(ahead, AT)
    return base.join(moved, AT, "left")


def variance_loss(pixels: DataFrame, metrics: str = "metrics", emb: str = "emb", k: int = 10, margin: float = 0.5, side: int = 32, max_tiles: int | None = None, max_pixels: int | None = None, seed: int = 0) -> DataFrame:
    """Repulsion of the k pixels of a tile that are farthest in metric space, averaged over a frame's tiles.

    All whole tiles of `side` pixels are taken with all their pixels, so `side` bounds a tile's pairs, and tiles spread over tasks.
    A training step that wants a draw of them names it: `max_tiles` of a frame at most in the order of a scatter of their
    places, and evenly spaced pixels of each, `max_pixels` at most.
    """
    plane, tile = ["movie", "t", "z"], ["movie", "t", "z", "ty", "tx"]
    ends = pixels.groupBy(*plane).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    ends = ends.withColumn("side", F.least(F.lit(side), "h", "w"))
    p = pixels.join(ends, plane).withColumn("ty", F.floor(F.col("y") / F.col("side"))).withColumn("tx", F.floor(F.col("x") / F.col("side")))
    p = p.filter(((F.col("ty") + 1) * F.col("side") <= F.col("h")) & ((F.col("tx") + 1) * F.col("side") <= F.col("w")))
    if max_tiles is not None:
        chosen = p.select(*tile).distinct().withColumn("n", F.row_number().over(Window.partitionBy(*plane).orderBy(mixed(F.col("ty") * 65537 + F.col("tx"), seed), "ty", "tx"))).filter(F.col("n") <= max_tiles)
        p = p.join(chosen.select(*tile), tile, "left_semi")
    at = (F.col("y") - F.col("ty") * F.col("side")) * F.col("side") + F.col("x") - F.col("tx") * F.col("side")
    p = p.withColumn("at", at)
    if max_pixels is not None:
        every = F.greatest(F.lit(1), F.floor(F.col("side") * F.col("side") / max_pixels))
        p = p.filter((F.col("at") % every == 0) & (F.col("at") < every * max_pixels))
    p = p.select(*tile, "at", vectors.normalise(F.col(metrics), 1e-12).alias("m"), vectors.normalise(F.col(emb), 1e-12).alias("e"))
    pairs = vectors.block_extremes(p, tile, "at", "m", 0, k, blocks=1, keep=tile)
    ranked = pairs.withColumn("far", F.row_number().over(Window.partitionBy(*tile, "i").orderBy(F.desc("d2"), "j"))).filter(F.col("far") <= k)
    e = p.select(*tile, F.col("at"), "e")
    sims = ranked.join(e.withColumnsRenamed({"at": "i", "e": "ei"}), [*tile, "i"]).join(e.withColumnsRenamed({"at": "j", "e": "ej"}), [*tile, "j"])
    terms = sims.groupBy(*tile).agg(F.avg(F.greatest(margin + vectors.dot(F.col("ei"), F.col("ej")), F.lit(0.0))).alias("loss"))
    return terms.groupBy(*plane).agg(F.avg("loss").alias("loss"), F.count(F.lit(1)).alias("n_tiles"))


def momentum_velocity(points: DataFrame, decay: float = 0.8) -> DataFrame:
    """Weighted mean of each track's frame-to-frame displacements, each one back weighing `decay` times as much."""
    key = ["movie", "track_id"]
    w = Window.partitionBy(*key).orderBy("t")
    axes = ["z_um", "y_um", "x_um"]
    steps = points.select(*key, "t", *[(F.col(a) - F.lag(a).over(w)).alias(f"d{a}") for a in axes]).filter("dz_um is not null")
    back = F.count(F.lit(1)).over(Window.partitionBy(*key)) - F.row_number().over(w)
    steps = steps.withColumn("w", F.pow(F.lit(decay), back.cast("double")))
    return steps.groupBy(*key).agg(*[(F.sum(F.col("w") * F.col(f"d{a}")) / F.sum("w")).alias(f"v{a[0]}") for a in axes])


def from_external(links: DataFrame, detections: DataFrame, least: int = 2) -> DataFrame:
    """Points of another program's tracks (movie, track_id, t, ref): references to detections' cells, those below 0 standing for gaps.

    References that no detection of the frame has are dropped, and then tracks of fewer than `least` points.
    """
    cells = detections.select("movie", "t", F.col("cell_id").alias("ref"), "z_um", "y_um", "x_um")
    found = links.filter("ref >= 0").join(cells, ["movie", "t", "ref"])
    n = F.count(F.lit(1)).over(Window.partitionBy("movie", "track_id"))
    return found.withColumn("__n", n).filter(F.col("__n") >= least).select("movie", "track_id", "t", F.col("ref").alias("cell_id"), "z_um", "y_um", "x_um")
