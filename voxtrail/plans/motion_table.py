"""The motion features of a movie as one table: fields at several scales to normalised, named metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from voxtrail.operators import motion

AT = ["movie", "t", "z", "y", "x"]


def motion_metrics(flow: DataFrame, frames: DataFrame, scales: list[int], window: int = 5) -> DataFrame:
    """Rows (movie, t, z, y, x, name, value) of all metrics of frames that have a field at every scale.

    Every metric but the stability of direction is scaled by its percentiles in the frame.
    """
    first, last = min(scales), max(scales)
    base = flow.filter(F.col("scale") == first)
    shape = motion.deformation(base)
    along = motion.alignment(base, frames)
    edge = motion.structure_tensor(frames)
    parts = [motion.magnitudes(flow.filter(F.col("scale") == s)).select("movie", F.col("t0").alias("t"), "z", "y", "x", F.lit(f"mag_{s}").alias("name"), F.col("mag").alias("value")) for s in scales]
    parts += [_named(shape, "t0", n) for n in ("divergence", "vorticity", "strain")]
    parts += [_named(along, "t0", n) for n in ("flow_structure_alignment", "normal_flow", "tangential_flow")]
    parts += [_named(edge, "t", "edge_strength"), _named(motion.magnitudes(motion.cumulative(flow, window)).withColumnRenamed("mag", "cumulative_mag"), "center_t", "cumulative_mag")]
    rows = motion.normalise_metric(reduce(DataFrame.unionByName, parts), ["movie", "t", "name"])
    wide = motion.pivot_metrics(rows.filter(F.col("name").isin(f"mag_{first}", "cumulative_mag", "edge_strength", "tangential_flow")), [f"mag_{first}", "cumulative_mag", "edge_strength", "tangential_flow"])
    boundary = wide.select(*AT, F.lit("cell_boundary_likelihood").alias("name"), motion.boundary_likelihood(F.col(f"mag_{first}"), F.col("cumulative_mag"), F.col("edge_strength"), F.col("tangential_flow")).alias("value")).filter("value is not null")
    rows = rows.unionByName(motion.normalise_metric(boundary, ["movie", "t", "name"]))
    if len(scales) > 1:
        rows = rows.unionByName(_named(motion.acceleration(flow, first, last), "t0", "acceleration")).unionByName(_named(motion.direction_stability(flow, first, last), "t0", "direction_stability"))
    return rows


def _named(df: DataFrame, time: str, name: str) -> DataFrame:
    return df.select("movie", F.col(time).cast("int").alias("t"), "z", "y", "x", F.lit(name).alias("name"), F.col(name).alias("value"))
