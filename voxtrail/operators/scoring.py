"""Quality of trajectories: identity switches, continuity, fragmentation and lengths.

Tracks are rows (movie, track_id, t, ...); colours are identities known by other means,
negative where unknown.  Undefined ratios are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from voxtrail.operators.joins import nearest
from voxtrail.session import pin

KEY = ["movie", "track_id"]
MATCH_UM = 50.0
PLACE = ["z_um", "y_um", "x_um"]


def point_colours(points: DataFrame, detections: DataFrame, radius: float = MATCH_UM) -> DataFrame:
    """movie, track_id, t and colour of the nearest detection of the frame, -1 beyond `radius`; detections are in µm."""
    found = nearest(points, detections.select("movie", "t", "cell_id", "color_id", *PLACE), ["movie", "t"], radius, PLACE, [*KEY, "t"], "cell_id")
    return points.select(*KEY, "t").join(found.select(*KEY, "t", F.col("b.color_id").alias("color_id")), [*KEY, "t"], "left").withColumn("color_id", F.coalesce("color_id", F.lit(-1)))


def steps(points: DataFrame) -> DataFrame:
    """Points of known colour with what stood before them in their track."""
    w = Window.partitionBy(*KEY).orderBy("t")
    known = points.filter("color_id >= 0").withColumn("before", F.lag("color_id").over(w)).withColumn("gap", F.col("t") - F.lag("t").over(w))
    return known.withColumn("switch", F.coalesce((F.col("color_id") != F.col("before")).cast("int"), F.lit(0)))


def track_switches(points: DataFrame) -> DataFrame:
    """Switches, transitions and rate of each track with two points of known colour; runs between switches; dominant colour."""
    lengths = points.groupBy(*KEY).agg(F.count(F.lit(1)).alias("length"))
    at = steps(points)
    per = at.groupBy(*KEY).agg(
        F.sum("switch").cast("bigint").alias("switches"),
        (F.count(F.lit(1)) - 1).alias("transitions"),
        F.sum(F.when(F.col("gap") == 1, F.col("switch")).otherwise(0)).cast("bigint").alias("within_run"),
        F.sum(F.when(F.col("gap") > 1, F.col("switch")).otherwise(0)).cast("bigint").alias("at_gap"),
    )
    per = per.filter("transitions >= 1").withColumn("switch_rate", F.col("switches") / F.col("transitions")).withColumn("mean_run_len", (F.col("transitions") + 1) / (F.col("switches") + 1))
    return per.join(dominant_colours(points), KEY).join(lengths, KEY)


def dominant_colours(points: DataFrame) -> DataFrame:
    """Most frequent known colour of each track; the smaller one on ties."""
    counts = points.filter("color_id >= 0").groupBy(*KEY, "color_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*KEY).agg(F.max_by("color_id", F.struct("n", -F.col("color_id"))).alias("dominant_color"))


def run_lengths(points: DataFrame) -> DataFrame:
    """Length of every run of one colour in tracks of two known points and more."""
    w = Window.partitionBy(*KEY).orderBy("t")
    runs = steps(points).withColumn("run", F.sum("switch").over(w)).withColumn("known", F.count(F.lit(1)).over(Window.partitionBy(*KEY)))
    return runs.filter("known >= 2").groupBy(*KEY, F.col("run").cast("bigint").alias("run")).agg(F.count(F.lit(1)).alias("run_len"))


def frame_continuity(points: DataFrame) -> DataFrame:
    """For each frame followed by the next one, the share of its tracks that are in that too."""
    at = points.select(*KEY, "t").distinct()
    w = Window.partitionBy(*KEY).orderBy("t")
    per = at.withColumn("survives", F.coalesce((F.lead("t").over(w) == F.col("t") + 1).cast("int"), F.lit(0)))
    per = per.groupBy("movie", "t").agg(F.count(F.lit(1)).alias("n_active"), F.sum("survives").cast("bigint").alias("n_bridge"))
    frames = per.select("movie", (F.col("t") - 1).cast("int").alias("t"))
    return per.join(frames, ["movie", "t"], "left_semi").withColumn("continuity", F.col("n_bridge") / F.col("n_active"))


def length_stats(points: DataFrame) -> DataFrame:
    """Track length statistics by movie; median and quartiles are cut to whole numbers."""
    n = points.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    whole = lambda p: F.percentile("n", F.lit(p)).cast("bigint")
    return n.groupBy("movie").agg(F.count(F.lit(1)).alias("n_total"), F.min("n").alias("min_len"), whole(0.25).alias("pct25"), whole(0.5).alias("median_len"), F.avg("n").alias("mean_len"), whole(0.75).alias("pct75"), F.max("n").alias("max_len"))


def fragmentation(switches: DataFrame) -> DataFrame:
    """Tracks of each dominant colour, summed up by movie."""
    per = switches.groupBy("movie", "dominant_color").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("movie").agg(F.count(F.lit(1)).alias("n_cells_evaluated"), F.percentile("n", F.lit(0.5)).alias("frag_median"), F.avg("n").alias("frag_mean"), F.max("n").alias("frag_max"), F.percentile("n", F.lit(0.75)).alias("frag_pct75"), F.avg((F.col("n") > 1).cast("int")).alias("frac_fragmented"))


def report(points: DataFrame) -> DataFrame:
    """One row of scores for each movie, from points with colours, which are written once as four scores read them."""
    points = pin(points.select(*KEY, "t", "color_id"))
    switches = track_switches(points)
    rates = switches.groupBy("movie").agg(
        F.count(F.lit(1)).alias("n_evaluated"),
        F.sum("switches").alias("n_switches"),
        F.sum("transitions").alias("n_transitions"),
        F.sum("within_run").alias("within_run"),
        F.sum("at_gap").alias("at_gap"),
        F.avg("mean_run_len").alias("mean_seg_len"),
    ).withColumn("color_switch_rate", F.col("n_switches") / F.col("n_transitions"))
    steady = frame_continuity(points).groupBy("movie").agg(F.avg("continuity").alias("continuity_mean"), F.min("continuity").alias("continuity_min"), F.max("continuity").alias("continuity_max"))
    out = length_stats(points)
    for part in (rates, steady, fragmentation(switches)):
        out = out.join(part, "movie", "left")
    return out


def objective(switch_rate: Column, continuity: Column, w_switch: float = 0.5, w_continuity: float = 0.5) -> Column:
    """The scalar that a search maximises."""
    return -(w_switch * switch_rate + w_continuity * (1 - continuity))


def tracks_to_matrix(points: DataFrame, resolution: dict[str, float], min_track_len: int = 1) -> DataFrame:
    """track_id, t, z, y, x in voxels for tracks of `min_track_len` points and more."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*KEY))
    kept = points.withColumn("__n", n).filter(F.col("__n") >= min_track_len)
    return kept.select("movie", F.col("track_id").cast("double").alias("track_id"), F.col("t").cast("double").alias("t"), *[(F.col(f"{a}_um") / resolution[a]).alias(a) for a in "zyx"])
