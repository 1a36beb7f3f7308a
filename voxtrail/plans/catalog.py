"""All named queries of the engine and their DuckDB counterparts.

A query is a function of (spark, sf_dir); `query` registers it with the SQL that
gives the same rows, where SQL can.  Doubles are rounded to six digits in both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from voxtrail import adapters as A
from voxtrail.operators import adaptive, joins, labels, motion, scoring, sweeps, tracking, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
CHANNELS = ["v0", "v1", "v2"]


def query(oracle: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return register


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def tidy(df: DataFrame) -> DataFrame:
    """Rounds all doubles; a negative zero becomes zero."""
    return df.select(*[(r6(c) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def coloured_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track points with the colour of the nearest detection."""
    d = A.detections(spark, sf_dir)
    um = d.select("*", *[(F.col(f"c{a}") * A.RESOLUTION[a]).alias(f"{a}_um") for a in "zyx"])
    return scoring.point_colours(A.track_points(spark, sf_dir), um)


_POINTS = (
    A.oracle("det", "track")
    + """, um as (select *, cz * 4.0::double as z_um, cy * 0.48::double as y_um, cx * 0.48::double as x_um from det),
    near as (
        select p.movie, p.track_id, p.t, d.color_id,
            row_number() over (partition by p.movie, p.track_id, p.t order by sqrt((p.z_um - d.z_um) * (p.z_um - d.z_um) + (p.y_um - d.y_um) * (p.y_um - d.y_um) + (p.x_um - d.x_um) * (p.x_um - d.x_um)), d.cell_id) as n
        from track p join um d on p.movie = d.movie and p.t = d.t
        where sqrt((p.z_um - d.z_um) * (p.z_um - d.z_um) + (p.y_um - d.y_um) * (p.y_um - d.y_um) + (p.x_um - d.x_um) * (p.x_um - d.x_um)) <= 50),
    pc as (select p.movie, p.track_id, p.t, coalesce(n.color_id, -1) as color_id from track p left join near n on p.movie = n.movie and p.track_id = n.track_id and p.t = n.t and n.n = 1),
    step as (
        select *, lag(color_id) over w as before, t - lag(t) over w as gap, coalesce((color_id <> lag(color_id) over w)::int, 0) as switch
        from pc where color_id >= 0 window w as (partition by movie, track_id order by t)),
    dom as (
        select movie, track_id, color_id as dominant_color from (
            select movie, track_id, color_id, row_number() over (partition by movie, track_id order by count(*) desc, color_id) as n from pc where color_id >= 0 group by movie, track_id, color_id) where n = 1),
    len as (select movie, track_id, count(*) as length from pc group by movie, track_id),
    per as (
        select movie, track_id, sum(switch)::bigint as switches, count(*) - 1 as transitions, sum(case when gap = 1 then switch else 0 end)::bigint as within_run, sum(case when gap > 1 then switch else 0 end)::bigint as at_gap
        from step group by movie, track_id having count(*) >= 2),
    sw as (select per.*, switches / transitions::double as switch_rate, (transitions + 1) / (switches + 1)::double as mean_run_len, dominant_color, length from per join dom using (movie, track_id) join len using (movie, track_id)),
    act as (select movie, t, count(*) as n_active, sum(survives)::bigint as n_bridge from (
        select movie, track_id, t, coalesce((lead(t) over (partition by movie, track_id order by t) = t + 1)::int, 0) as survives from pc) group by movie, t),
    cont as (select a.*, n_bridge / n_active::double as continuity from act a where exists (select 1 from act b where b.movie = a.movie and b.t = a.t + 1))
"""
)


@query(_POINTS + "select movie, track_id, t, color_id from pc")
def point_colours(spark, sf_dir):
    return coloured_points(spark, sf_dir)


@query(_POINTS + "select movie, track_id, switches, transitions, within_run, at_gap, round(switch_rate, 6) as switch_rate, round(mean_run_len, 6) as mean_run_len, dominant_color, length from sw")
def track_switches(spark, sf_dir):
    return tidy(scoring.track_switches(coloured_points(spark, sf_dir)))


@query(_POINTS + ", runs as (select *, sum(switch) over (partition by movie, track_id order by t) as run, count(*) over (partition by movie, track_id) as known from step) select movie, track_id, run::bigint as run, count(*) as run_len from runs where known >= 2 group by movie, track_id, run")
def run_lengths(spark, sf_dir):
    return scoring.run_lengths(coloured_points(spark, sf_dir))


@query(_POINTS + "select movie, t, n_active, n_bridge, round(continuity, 6) as continuity from cont")
def frame_continuity(spark, sf_dir):
    return tidy(scoring.frame_continuity(A.track_points(spark, sf_dir)))


@query(
    _POINTS
    + """select l.*, n_evaluated, n_switches, n_transitions, within_run, at_gap, round(mean_seg_len, 6) as mean_seg_len, round(color_switch_rate, 6) as color_switch_rate,
        round(continuity_mean, 6) as continuity_mean, round(continuity_min, 6) as continuity_min, round(continuity_max, 6) as continuity_max,
        n_cells_evaluated, round(frag_median, 6) as frag_median, round(frag_mean, 6) as frag_mean, frag_max, round(frag_pct75, 6) as frag_pct75, round(frac_fragmented, 6) as frac_fragmented
    from (select movie, count(*) as n_total, min(length) as min_len, floor(quantile_cont(length, 0.25))::bigint as pct25, floor(quantile_cont(length, 0.5))::bigint as median_len, round(avg(length), 6) as mean_len, floor(quantile_cont(length, 0.75))::bigint as pct75, max(length) as max_len from len group by movie) l
    left join (select movie, count(*) as n_evaluated, sum(switches)::bigint as n_switches, sum(transitions)::bigint as n_transitions, sum(within_run)::bigint as within_run, sum(at_gap)::bigint as at_gap, avg(mean_run_len) as mean_seg_len, sum(switches) / sum(transitions)::double as color_switch_rate from sw group by movie) r using (movie)
    left join (select movie, avg(continuity) as continuity_mean, min(continuity) as continuity_min, max(continuity) as continuity_max from cont group by movie) c using (movie)
    left join (select movie, count(*) as n_cells_evaluated, quantile_cont(n, 0.5)::double as frag_median, avg(n) as frag_mean, max(n) as frag_max, quantile_cont(n, 0.75)::double as frag_pct75, avg((n > 1)::int) as frac_fragmented from (select movie, dominant_color, count(*) as n from sw group by movie, dominant_color) group by movie) f using (movie)"""
)
def tracking_report(spark, sf_dir):
    """The flagship: the quality report of every movie."""
    return tidy(scoring.report(coloured_points(spark, sf_dir)))


@query(_POINTS + ", s as (select movie, sum(switches) / sum(transitions)::double as sr from sw group by movie), k as (select movie, avg(continuity) as c from cont group by movie) select movie, round(-(0.5 * sr + 0.5 * (1 - c)), 6) as objective from s join k using (movie)")
def search_objective(spark, sf_dir):
    rep = scoring.report(coloured_points(spark, sf_dir))
    return rep.select("movie", r6(scoring.objective(F.col("color_switch_rate"), F.col("continuity_mean"))).alias("objective"))


@query(A.oracle("det", "track") + "select movie, track_id::double as track_id, t::double as t, z_um / 4.0 as z, round(y_um / 0.48, 6) as y, round(x_um / 0.48, 6) as x from (select *, count(*) over (partition by movie, track_id) as n from track) where n >= 5")
def tracks_to_matrix(spark, sf_dir):
    return tidy(scoring.tracks_to_matrix(A.track_points(spark, sf_dir), A.RESOLUTION, 5))


@query(A.oracle("det") + "select color_id, count(*) as n from det group by color_id")
def colour_histogram(spark, sf_dir):
    return A.detections(spark, sf_dir).groupBy("color_id").agg(F.count(F.lit(1)).alias("n"))


# ---- label maps -------------------------------------------------------------------------------------------------

_VOX = A.oracle("voxel")


@query(_VOX + "select movie, t, label, count(*) as n_vox from voxel where label > 0 group by all having count(*) >= 30")
def filter_small_cells(spark, sf_dir):
    return labels.filter_small(A.voxels(spark, sf_dir), 30).groupBy("movie", "t", "label").agg(F.count(F.lit(1)).alias("n_vox"))


@query(_VOX + ", top as (select movie, t, y, x, max(label) as label from voxel where label > 0 group by all), keep as (select movie, t, label from top group by all having count(*) >= 15) select movie, t, label, count(*) as n_vox from voxel where label > 0 and (t, label) not in (select t, label from (select movie, t, label from top group by all having count(*) < 15)) group by all")
def filter_small_projected(spark, sf_dir):
    return labels.filter_small_projected(A.voxels(spark, sf_dir), 15).groupBy("movie", "t", "label").agg(F.count(F.lit(1)).alias("n_vox"))


@query(_VOX + ", n as (select movie, t, z, label, count(*) as n from voxel where label > 0 group by all having count(*) >= 4) select movie, t, z, label, row_number() over (partition by movie, t, z order by label)::int as new_label, n as n_vox from n")
def reindex_labels(spark, sf_dir):
    return labels.reindex(A.voxels(spark, sf_dir), 4).groupBy("movie", "t", "z", "label", "new_label").agg(F.count(F.lit(1)).alias("n_vox"))


@query(_VOX + "select movie, t, label, round(avg(z), 6) as cz, round(avg(y), 6) as cy, round(avg(x), 6) as cx, count(*) as n_vox from voxel where label > 0 group by all")
def cell_centroids(spark, sf_dir):
    return tidy(labels.centroids(A.voxels(spark, sf_dir)))


@query(_VOX + "select movie, t, label, round(avg(v0), 6) as mean_v0, round(avg(v1), 6) as mean_v1, round(avg(v2), 6) as mean_v2 from voxel where label > 0 group by all")
def cell_intensities(spark, sf_dir):
    return tidy(labels.intensities(A.voxels(spark, sf_dir), CHANNELS))


@query(_VOX + ", c as (select 'm' || (label % 3)::varchar as movie, t, label, avg(v0) as a, avg(v1) as b, avg(v2) as c, greatest(avg(v0), avg(v1), avg(v2)) as g from voxel where label > 0 group by all), q as (select movie, quantile_cont(g, 0.1) as cut from c group by movie) select movie, t, label, (case when g <= cut then -1 when a = g then 0 when b = g then 1 else 2 end)::int as color_id, round(g, 6) as greatest from c join q using (movie)")
def cell_colours(spark, sf_dir):
    """Three movies, each with a threshold of its own."""
    v = A.voxels(spark, sf_dir).withColumn("movie", F.concat(F.lit("m"), (F.col("label") % 3).cast("string")))
    return tidy(labels.dominant_channel(labels.intensities(v, CHANNELS), CHANNELS))


_PAIR = A.oracle("pair")


@query(_PAIR + "select a, b, count(*) as n from pair group by a, b")
def label_overlaps(spark, sf_dir):
    return labels.overlaps(A.label_pairs(spark, sf_dir))


@query(_PAIR + ", o as (select a, b, count(*) as n from pair group by a, b), m as (select *, sum(n) over (partition by a)::bigint as size_a, sum(n) over (partition by b)::bigint as size_b from o) select a, b, n, size_a, size_b, round(n / (size_a + size_b - n)::double, 6) as iou from m where a > 0 and b > 0")
def label_jaccard(spark, sf_dir):
    return tidy(labels.jaccard(labels.overlaps(A.label_pairs(spark, sf_dir))))


_SLICE = _VOX + """, v as (select * from voxel where label > 0),
    s as (select movie, t, z, label, count(*) as size from v group by all),
    n as (select a.movie, a.t, a.z, a.label, b.label as label_up, count(*) as n from v a join v b on a.movie = b.movie and a.t = b.t and a.z = b.z - {k} and a.y = b.y and a.x = b.x group by all)
    select n.movie, n.t, n.z, n.label, n.label_up, n.n, s.size, u.size as size_up, round(n.n / (s.size + u.size - n.n)::double, 6) as iou
    from n join s using (movie, t, z, label) join s u on u.movie = n.movie and u.t = n.t and u.z = n.z + {k} and u.label = n.label_up"""


@query(_SLICE.format(k=1))
def slice_overlaps(spark, sf_dir):
    return tidy(labels.slice_overlaps(A.voxels(spark, sf_dir), 1))


@query(_SLICE.format(k=2))
def slice_overlaps_over_gap(spark, sf_dir):
    return tidy(labels.slice_overlaps(A.voxels(spark, sf_dir), 2))


_KIND = _VOX + """, f as (select movie, t, avg(v0) as f0, avg(v1) as f1, avg(v2) as f2 from voxel group by all),
    c as (select movie, t, label, count(*) as size, avg(v0) as a, avg(v1) as b, avg(v2) as c from voxel where label > 0 group by all),
    k as (select movie, t, label, size, a / (f0 + 1e-6) as a, b / (f1 + 1e-6) as b, c / (f2 + 1e-6) as c from c join f using (movie, t)),
    kind as (select movie, t, label, size, greatest(a, b, c) / (a + b + c) as purity, case when size < 20 or a + b + c < 1e-6 then 'fragmented' when greatest(a, b, c) / (a + b + c) >= 0.38 then 'good' else 'merged' end as kind from k)
"""


@query(_KIND + "select movie, t, label, size, round(purity, 6) as purity, kind from kind")
def cell_classes(spark, sf_dir):
    return tidy(labels.classify(A.voxels(spark, sf_dir), CHANNELS, 20, 0.38))


@query(_KIND + ", n as (select movie, t, sum((kind = 'good')::int)::bigint as n_good, sum((kind = 'merged')::int)::bigint as n_merged, sum((kind = 'fragmented')::int)::bigint as n_fragmented from kind group by all) select *, round((case when n_good + n_merged > 0 then n_good / (n_good + n_merged)::double else 0 end) - 0.01 * (n_good + n_merged + n_fragmented), 6) as score from n")
def segmentation_purity(spark, sf_dir):
    return tidy(labels.purity_score(labels.classify(A.voxels(spark, sf_dir), CHANNELS, 20, 0.38), 0.01))


@query(_VOX + ", l as (select movie, t, label, max(z) as last_z from voxel where label > 0 group by all) select movie, t, last_z, count(*) as n_labels from l group by all")
def label_last_slices(spark, sf_dir):
    return labels.last_slices(A.voxels(spark, sf_dir))


@query(_VOX + ", v as (select distinct movie, t, z, y, x, label from voxel where label > 0), p as (select distinct b.movie, b.t, b.z, a.label as a, b.label as b, b.y, b.x from v a join v b on a.movie = b.movie and a.t = b.t and a.z = b.z and abs(a.y - b.y) + abs(a.x - b.x) = 1 and a.label <> b.label) select movie, t, z, a, b, count(*) as n_contact from p group by all")
def label_contacts(spark, sf_dir):
    return labels.contacts(A.voxels(spark, sf_dir))


@query(_VOX + "select movie, t, count(distinct label) as num_cells from voxel where label > 0 group by all")
def cells_per_frame(spark, sf_dir):
    return labels.frame_counts(labels.foreground(A.voxels(spark, sf_dir)))


@query(_VOX + ", n as (select movie, t, label, count(*) as n from voxel where label > 0 group by all) select movie, t, count(*) as n_before, sum((n >= 30)::int)::bigint as n_after from n group by all")
def counts_before_after_filter(spark, sf_dir):
    return labels.count_before_after(A.voxels(spark, sf_dir), 30)


@query(
    _VOX
    + """, p as (select distinct movie, t, label, y, x from voxel where label > 0),
    m as (select movie, t, label, count(*) as area, max(y) - min(y) + 1 as h, max(x) - min(x) + 1 as w, avg(y * y) - avg(y) * avg(y) + 1 / 12.0::double as myy, avg(x * x) - avg(x) * avg(x) + 1 / 12.0::double as mxx, avg(y * x) - avg(y) * avg(x) as mxy from p group by all),
    l as (select *, (mxx + myy + sqrt((mxx - myy) * (mxx - myy) + 4 * mxy * mxy)) / 2 as l1, greatest((mxx + myy - sqrt((mxx - myy) * (mxx - myy) + 4 * mxy * mxy)) / 2, 0) as l2 from m)
    select movie, t, label, area, round(area / (h * w)::double, 6) as extent, round(4 * sqrt(l1), 6) as axis_major, round(4 * sqrt(l2), 6) as axis_minor, round(sqrt(1 - l2 / l1), 6) as eccentricity, round(sqrt(4 * area / pi()), 6) as equivalent_diameter, round(sqrt(l1) / greatest(sqrt(l2), 1e-9), 6) as aspect_ratio from l where area >= 10"""
)
def shape_moments(spark, sf_dir):
    return tidy(labels.shape_moments(A.voxels(spark, sf_dir)).filter("area >= 10"))


@query(A.oracle("voxel", "flow") + "select v.movie, v.t, v.label, round(avg(f.u), 6) as u, round(avg(f.v), 6) as v from voxel v join flow f on v.t = f.t0 and f.scale = 1 and f.y = v.y and f.x = v.x and v.z = f.z where v.label > 0 group by all")
def cell_flows(spark, sf_dir):
    field = A.fields(spark, sf_dir).filter("scale = 1").withColumnRenamed("t0", "t")
    return tidy(labels.mean_field(A.voxels(spark, sf_dir), field, ["u", "v"]))


@query(A.oracle("voxel", "flow") + "select movie, t0 as t, y, x, round(avg(u), 6) as u, round(avg(v), 6) as v from flow f where scale = 1 and exists (select 1 from voxel v where v.label > 0 and v.t = f.t0 and v.z = f.z) group by all")
def dense_flow(spark, sf_dir):
    field = A.fields(spark, sf_dir).filter("scale = 1").withColumnRenamed("t0", "t")
    return tidy(labels.dense_mean_field(A.voxels(spark, sf_dir), field, ["u", "v"]))


@query(A.oracle("voxel", "pixel") + "select v.movie, v.t, v.label, p.c, round(avg(p.v), 6) as mean_v, count(*) as n from voxel v join pixel p on v.t = p.t and v.z = p.z and v.y = p.y and v.x = p.x where v.label > 0 group by all")
def sampled_channels(spark, sf_dir):
    return tidy(labels.sample_channels(A.voxels(spark, sf_dir), A.pixels(spark, sf_dir)))


# ---- normalisation and motion -----------------------------------------------------------------------------------

_FLOW = A.oracle("flow")
_PIX = A.oracle("pixel")


@query(_FLOW + ", m as (select *, sqrt(u * u + v * v) as mag from flow), q as (select movie, t0, scale, quantile_cont(mag, 0.0002) as a, quantile_cont(mag, 0.9998) as b from m group by all) select m.movie, m.t0, m.scale, y, x, round(greatest(least((mag - a) / (b - a + 1e-8), 1), 0), 6) as mag from m join q using (movie, t0, scale)")
def normalised_magnitude(spark, sf_dir):
    m = motion.normalise_metric(motion.magnitudes(A.fields(spark, sf_dir)), motion.FLOW_KEY, "mag")
    return tidy(m.select("movie", "t0", "scale", "y", "x", "mag"))


@query(_PIX + "select movie, t, c, y, x, round((v - min(v) over w) / (max(v) over w - min(v) over w + 1e-5), 6) as v from pixel window w as (partition by movie, c)")
def minmax_normalised(spark, sf_dir):
    return tidy(motion.normalise_minmax(A.pixels(spark, sf_dir), ["movie", "c"], "v").drop("z"))


@query(_PIX + ", q as (select t, c, quantile_cont(v, 0.01) as a, quantile_cont(v, 0.99) as b from pixel group by all) select movie, t, c, y, x, round(case when b > a then (v - a) / (b - a) else 0 end, 6) as v from pixel join q using (t, c)")
def range_normalised(spark, sf_dir):
    return tidy(motion.normalise_range(A.pixels(spark, sf_dir), ["movie", "t", "c"], "v").drop("z"))


@query(_PIX + "select movie, t, c, y, x, round(case when max(v) over w - min(v) over w > 1e-8 then (v - min(v) over w) / (max(v) over w - min(v) over w) else 0 end, 6) as v from pixel window w as (partition by movie, t, c)")
def training_normalised(spark, sf_dir):
    return tidy(motion.normalise_training(A.pixels(spark, sf_dir), ["movie", "t", "c"], "v").drop("z"))


@query(_PIX + "select movie, t, c, y, x, floor(case when max(v) over w > min(v) over w then (v - min(v) over w) / (max(v) over w - min(v) over w) * 255 else 0 end)::int as v from pixel window w as (partition by movie, t, c)")
def scaled_to_bytes(spark, sf_dir):
    return motion.to_bytes(A.pixels(spark, sf_dir), ["movie", "t", "c"], "v").drop("z")


@query(_PIX + ", q as (select movie, c, quantile_cont(v, 0.0001) as a, quantile_cont(v, 0.9999) as b from pixel group by movie, c) select movie, t, z, y, x, max(floor(greatest(least((v - a) / (b - a + 1e-8), 1), 0) * 255)::int) as v from pixel join q using (movie, c) group by all")
def projected_channels(spark, sf_dir):
    return motion.project_channels(A.pixels(spark, sf_dir))


_GRAD = "coalesce(case when lag({v}) over {w} is null then lead({v}) over {w} - {v} when lead({v}) over {w} is null then {v} - lag({v}) over {w} else (lead({v}) over {w} - lag({v}) over {w}) / 2 end, 0)"


@query(
    _FLOW
    + f""", g as (select *, {_GRAD.format(v="u", w="r")} as ux, {_GRAD.format(v="u", w="k")} as uy, {_GRAD.format(v="v", w="r")} as vx, {_GRAD.format(v="v", w="k")} as vy
        from flow window r as (partition by movie, t0, scale, y order by x), k as (partition by movie, t0, scale, x order by y))
    select movie, t0, scale, y, x, round(ux + vy, 6) as divergence, round(vx - uy, 6) as vorticity, round(sqrt(0.5 * ((ux - vy) * (ux - vy) + (uy + vx) * (uy + vx))), 6) as strain from g"""
)
def flow_deformation(spark, sf_dir):
    return tidy(motion.deformation(A.fields(spark, sf_dir)).drop("t1", "z", "u", "v"))


@query(_FLOW + ", t as (select distinct movie, t0 as t from flow) select a.movie, a.t as t0, b.t as t1, (b.t - a.t)::int as scale from t a join t b on a.movie = b.movie and b.t - a.t in (1, 2, 4)")
def scale_pairs(spark, sf_dir):
    frames = A.fields(spark, sf_dir).select("movie", F.col("t0").alias("t")).distinct()
    return motion.scale_pairs(frames, [1, 2, 4])


@query(_FLOW + "select movie, t0 as center_t, y, x, round(sum(u) over w, 6) as u, round(sum(v) over w, 6) as v from flow where scale = 1 window w as (partition by movie, y, x order by t0 rows between 2 preceding and 1 following) union all select movie, t0 + 1, y, x, round(sum(u) over w, 6), round(sum(v) over w, 6) from flow where scale = 1 window w as (partition by movie, y, x order by t0 rows between 1 preceding and current row) qualify t0 = max(t0) over (partition by movie)")
def cumulative_displacement(spark, sf_dir):
    return tidy(motion.cumulative(A.fields(spark, sf_dir), 5).drop("z"))


@query(_FLOW + "select a.movie, a.t0, a.y, a.x, round(greatest(least((a.u * b.u + a.v * b.v) / (sqrt(a.u * a.u + a.v * a.v) * sqrt(b.u * b.u + b.v * b.v) + 1e-5), 1), 0), 6) + 0.0 as direction_stability from flow a join flow b using (movie, t0, y, x) where a.scale = 1 and b.scale = 4")
def direction_stability(spark, sf_dir):
    return tidy(motion.direction_stability(A.fields(spark, sf_dir), 1, 4).drop("z"))


@query(
    _FLOW
    + """, m as (select *, sqrt(u * u + v * v) as mag from flow), q as (select t0, scale, quantile_cont(mag, 0.0002) as a, quantile_cont(mag, 0.9998) as b from m group by all),
    n as (select m.t0, m.scale, y, x, greatest(least((mag - a) / (b - a + 1e-8), 1), 0) as mag from m join q using (t0, scale)),
    d as (select a.t0, a.y, a.x, abs(b.mag - a.mag) as acc from n a join n b using (t0, y, x) where a.scale = 1 and b.scale = 4),
    p as (select t0, quantile_cont(acc, 0.0002) as a, quantile_cont(acc, 0.9998) as b from d group by t0)
    select 'm' || (t0 // 24)::varchar as movie, t0, y, x, round(greatest(least((acc - a) / (b - a + 1e-8), 1), 0), 5) as acceleration from d join p using (t0)"""
)
def flow_acceleration(spark, sf_dir):
    d = motion.acceleration(A.fields(spark, sf_dir), 1, 4)
    return d.select("movie", "t0", "y", "x", F.round("acceleration", 5).alias("acceleration"))


@query(
    A.oracle("flow", "pixel")
    + f""", g as (select t as t0, y, x, {_GRAD.format(v="v", w="k")} as gx, {_GRAD.format(v="v", w="r")} as gy from pixel where c = 0 window r as (partition by t, y order by x), k as (partition by t, x order by y)),
    j as (select *, sqrt(gx * gx + gy * gy + 1e-5) as s, sqrt(u * u + v * v + 1e-5) as f from flow join g using (t0, y, x) where scale = 1)
    select movie, t0, scale, y, x, round(abs((gx * u + gy * v) / (s * f)), 6) as flow_structure_alignment, round(abs(u * gx / s + v * gy / s), 6) as normal_flow, round(abs(-u * gy / s + v * gx / s), 6) as tangential_flow from j"""
)
def flow_alignment(spark, sf_dir):
    return tidy(motion.alignment(A.fields(spark, sf_dir).filter("scale = 1"), A.pixels(spark, sf_dir).filter("c = 0")).drop("z"))


_MIRROR = "least(((({p} + o) % 32) + 32) % 32, 31 - ((({p} + o) % 32) + 32) % 32)"


@query(
    _PIX
    + f""", n as (select t, c, y, x, (v - min(v) over w) / (max(v) over w - min(v) over w + 1e-8) as v from pixel window w as (partition by movie, c)),
    g as (select o, exp(-(o * o) / 50.0) / sum(exp(-(o * o) / 50.0)) over () as w from (select (i - 20)::int as o from range(41) r(i))),
    gx as (select n.t, n.c, n.y, n.x, sum(g.w * m.v) as v from n cross join g join n m on m.t = n.t and m.c = n.c and m.y = n.y and m.x = {_MIRROR.format(p="n.x")} group by all),
    gy as (select n.t, n.c, n.y, n.x, sum(g.w * m.v) as v from gx n cross join g join gx m on m.t = n.t and m.c = n.c and m.x = n.x and m.y = {_MIRROR.format(p="n.y")} group by all),
    b as (select t, y, x, max(v) as bright from n group by all),
    e as (select *, exp((v - max(v) over p) / (0.3 + 1e-8)) as e from gy window p as (partition by t, y, x)),
    s as (select t, c, y, x, e / (sum(e) over (partition by t, y, x) + 1e-8) * bright as value from e join b using (t, y, x)), q as (select t, c, quantile_cont(value, 0.0002) as a, quantile_cont(value, 0.9998) as b from s group by all) select 'm' || (t // 24)::varchar as movie, t, c, y, x, round(greatest(least((value - a) / (b - a + 1e-8), 1), 0), 6) as value from s join q using (t, c)"""
)
def softmax_channels(spark, sf_dir):
    s = motion.softmax_channels(A.pixels(spark, sf_dir))
    return tidy(s.select("movie", "t", "c", "y", "x", "value"))


@query(
    _PIX
    + """, p as (select * from pixel where c = 0),
    n as (select a.t, a.y, a.x, a.v, sum(b.v) as s, sum(b.v * b.v) as q from p a join p b on a.t = b.t and abs(a.y - b.y) <= 2 and abs(a.x - b.x) <= 2 group by all),
    m as (select *, sqrt(greatest((q - s * s / 25) / 24, 0)) + 1e-5 as contrast, (coalesce(abs(lead(v) over (partition by t, y order by x) - v), 0) + coalesce(abs(lead(v) over (partition by t, x order by y) - v), 0)) / 2 as edge from n),
    k as (select t, avg(v) as av, stddev_samp(v) as sv, avg(contrast) as ac, stddev_samp(contrast) as sc, avg(edge) as ae, stddev_samp(edge) as se from m group by t)
    select 'm' || (t // 24)::varchar as movie, t, y, x, round(sqrt(0.5 * (v > av + sv + 1e-5)::int + 0.3 * greatest(least((contrast - ac) / (sc + 1e-5), 1), 0) + 0.2 * greatest(least((edge - ae) / (se + 1e-5), 1), 0)), 5) as target from m join k using (t)"""
)
def intensity_target(spark, sf_dir):
    t = motion.intensity_target(A.pixels(spark, sf_dir).filter("c = 0"))
    return t.select("movie", "t", "y", "x", F.round("target", 5).alias("target"))


_INSIDE = "least(((({p} + o) % 30) + 30) % 30, 30 - ((({p} + o) % 30) + 30) % 30)"
_SUMS = "sum(w.w * m.{0}) as {0}"


@query(
    _PIX
    + f""", p as (select * from pixel where c = 0),
    g as (select t, y, x, {_GRAD.format(v="v", w="k")} as gx, {_GRAD.format(v="v", w="r")} as gy from p window r as (partition by t, y order by x), k as (partition by t, x order by y)),
    f as (select t, y, x, gx * gx as xx, gy * gy as yy, gx * gy as xy from g),
    w as (select o, exp(-(o * o) / 8.0) / sum(exp(-(o * o) / 8.0)) over () as w from (select (i - 3)::int as o from range(7) r(i))),
    a as (select f.t, f.y, f.x, {", ".join(_SUMS.format(c) for c in ("xx", "yy", "xy"))} from f cross join w join f m on m.t = f.t and m.y = f.y and m.x = {_INSIDE.format(p="f.x")} group by all),
    b as (select a.t, a.y, a.x, {", ".join(_SUMS.format(c) for c in ("xx", "yy", "xy"))} from a cross join w join a m on m.t = a.t and m.x = a.x and m.y = {_INSIDE.format(p="a.y")} group by all)
    select 'm' || (t // 24)::varchar as movie, t, 0 as z, y, x, round(sqrt((xx - yy) * (xx - yy) + 4 * xy * xy), 6) as edge_strength from b"""
)
def structure_tensor(spark, sf_dir):
    """Gap of the eigenvalues of the blurred structure tensor."""
    return tidy(motion.structure_tensor(A.pixels(spark, sf_dir).filter("c = 0")))


@query(A.oracle("flow", "pixel") + ", f as (select distinct movie, t as t0 from pixel), g as (select distinct movie, z, y, x from flow), h as (select * from flow where scale = 1) select g.movie, f.t0, g.y, g.x, coalesce(u, 0) as u, coalesce(v, 0) as v from f join g on g.movie = f.movie left join h on h.t0 = f.t0 and h.y = g.y and h.x = g.x")
def filled_flow(spark, sf_dir):
    frames = A.pixels(spark, sf_dir).select("movie", "t").distinct()
    return motion.fill_frames(A.fields(spark, sf_dir), frames).drop("z")


@query(A.oracle("flow", "pixel") + "select movie, t, t in (select t0 from flow where scale = 1) as has_flow from (select distinct movie, t from pixel)")
def flow_pairs(spark, sf_dir):
    frames = A.pixels(spark, sf_dir).select("movie", "t").distinct()
    return motion.flow_pairs(frames, A.fields(spark, sf_dir))


@query(_FLOW + "select movie, t0 as t, z, y, x, max(case when scale = 1 then sqrt(u * u + v * v) end) as mag_1, max(case when scale = 2 then sqrt(u * u + v * v) end) as mag_2, max(case when scale = 4 then sqrt(u * u + v * v) end) as mag_4 from flow group by all")
def pivoted_metrics(spark, sf_dir):
    m = motion.magnitudes(A.fields(spark, sf_dir)).select("movie", F.col("t0").alias("t"), "z", "y", "x", F.concat(F.lit("mag_"), F.col("scale")).alias("name"), F.col("mag").alias("value"))
    return motion.pivot_metrics(m, ["mag_1", "mag_2", "mag_4"])


@query(_FLOW + ", f as (select distinct movie, t0 as t, scale from flow), n as (select scale, count(*) as n from f group by scale) select movie, t, scale, least(n - 1, greatest(0, t - 1))::int as flow_t from f join n using (scale)")
def flow_index(spark, sf_dir):
    f = A.fields(spark, sf_dir).select("movie", F.col("t0").alias("t"), "scale").distinct()
    n = f.groupBy("scale").agg(F.count(F.lit(1)).alias("n"))
    return f.join(n, "scale").select("movie", "t", "scale", motion.flow_index(F.col("t"), F.col("n")).cast("int").alias("flow_t"))


# ---- vectors ----------------------------------------------------------------------------------------------------

_EMB = A.oracle("pixel_emb")


@query(_EMB + ", e as (select fragment, generate_subscripts(emb, 1) - 1 as d, unnest(emb) as x from pixel_emb) select fragment, d::int as d, round(avg(x), 6) as x from e group by all")
def mean_embeddings(spark, sf_dir):
    m = vectors.mean_vectors(A.pixel_embeddings(spark, sf_dir), ["fragment"], "emb")
    return tidy(m.select("fragment", F.posexplode("emb").alias("d", "x")))


@query(
    _EMB
    + """, e as (select fragment, generate_subscripts(emb, 1) as d, unnest(emb) as x from pixel_emb), m as (select fragment, d, avg(x) as x from e group by all), n as (select fragment, sqrt(sum(x * x)) + 1e-5 as n from m group by fragment),
    p as (select a.fragment as a, b.fragment as b, sum(a.x * b.x) as s from m a join m b using (d) where b.fragment - a.fragment between 1 and 3 group by all)
    select a, b, round(s / (i.n * j.n), 6) as affinity from p join n i on i.fragment = a join n j on j.fragment = b"""
)
def fragment_affinity(spark, sf_dir):
    e = A.pixel_embeddings(spark, sf_dir)
    f = e.select("fragment").distinct()
    near = f.select(F.col("fragment").alias("a"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("step")).select("a", (F.col("a") + F.col("step")).alias("b"))
    pairs = near.join(f.select(F.col("fragment").alias("b")), "b", "left_semi")  # of fragments whose numbers are close
    return tidy(vectors.fragment_affinity(e, pairs))


def _ranked(spark, sf_dir):
    sample = vectors.sample_pixels(A.pixel_embeddings(spark, sf_dir), ["fragment"], "pixel")
    return vectors.nearest_and_farthest(vectors.block_extremes(sample, ["fragment"], "pixel", "emb", 10, 10), 10)


@query()
def embedding_neighbours(spark, sf_dir):
    """Nearest and farthest pixels of the same patch in embedding space, of 2000 sampled ones at most, as the loss takes them; ties in the last digit differ between engines, so tests use numpy."""
    return tidy(_ranked(spark, sf_dir).select("i", "j", "rank", "sim"))


@query(
    _EMB
    + """, s as (select * from pixel_emb qualify row_number() over (partition by fragment order by (pixel * 2654435761) % 4294967296, pixel) <= 2000), p as (select a.pixel as i, b.pixel as j, list_dot_product(a.emb, b.emb) as sim, list_distance(a.emb, b.emb) as d from s a join s b on a.fragment = b.fragment and a.pixel <> b.pixel),
    r as (select *, row_number() over (partition by i order by d, j) as near, row_number() over (partition by i order by d desc, j) as far from p)
    select round(avg(case when near <= 10 then greatest(1 - sim, 0) end), 6) as loss_pos, round(avg(case when far <= 10 then greatest(0.5 + sim, 0) end), 6) as loss_neg from r"""
)
def contrastive_terms(spark, sf_dir):
    return tidy(vectors.contrastive_terms(_ranked(spark, sf_dir)))


# ---- spatial and temporal joins ---------------------------------------------------------------------------------

_DET = A.oracle("det", "track")
_D2 = "sqrt((a.y_um - b.y_um) * (a.y_um - b.y_um) + (a.x_um - b.x_um) * (a.x_um - b.x_um))"
_LINKS = _DET + f", k as (select track.*, color_id from track join det using (movie, t, cell_id)), enc as (select a.movie, a.t, a.track_id as a, b.track_id as b, {_D2} as d from k a join k b on a.movie = b.movie and a.t = b.t where a.color_id <> b.color_id and {_D2} <= 8)\n"


def _known(spark, sf_dir):
    return A.track_points(spark, sf_dir).join(A.detections(spark, sf_dir).select("movie", "t", "cell_id", "color_id"), ["movie", "t", "cell_id"])


def _encounters(spark, sf_dir):
    k = _known(spark, sf_dir)
    return joins.within(k, k, ["movie", "t"], 8.0, ["y_um", "x_um"]).filter("a.color_id <> b.color_id")


@query(_LINKS + "select movie, t, a, b, round(d, 6) as d from enc")
def population_encounters(spark, sf_dir):
    return tidy(_encounters(spark, sf_dir).select("a.movie", "a.t", F.col("a.track_id").alias("a"), F.col("b.track_id").alias("b"), "d"))


@query(_LINKS + "select movie, track_id, t from k where exists (select 1 from enc where enc.movie = k.movie and enc.t = k.t and enc.a = k.track_id)")
def encounter_exists(spark, sf_dir):
    hit = _encounters(spark, sf_dir).select("a.movie", "a.track_id", "a.t").distinct()
    return _known(spark, sf_dir).select("movie", "track_id", "t").join(hit, ["movie", "track_id", "t"], "left_semi")


@query(_DET + "select a.movie, a.t, a.track_id as a, b.track_id as b from track a join track b on a.movie = b.movie and a.t = b.t and abs(a.y_um - b.y_um) <= 12 and abs(a.x_um - b.x_um) <= 12 where a.track_id <> b.track_id")
def box_candidates(spark, sf_dir):
    p = A.track_points(spark, sf_dir)
    found = joins.within_box(p, p, ["movie", "t"], 12.0, ["y_um", "x_um"]).filter("a.track_id <> b.track_id")
    return found.select("a.movie", "a.t", F.col("a.track_id").alias("a"), F.col("b.track_id").alias("b"))


_RUNS = _DET + ", g as (select *, t - row_number() over (partition by movie, track_id order by t) as island from track), s as (select movie, track_id, min(t) as t_start, max(t) as t_end from g group by movie, track_id, island)\n"


def _segments(spark, sf_dir):
    """Unbroken stretches of tracks."""
    w = Window.partitionBy("movie", "track_id").orderBy("t")
    g = A.track_points(spark, sf_dir).withColumn("island", F.col("t") - F.row_number().over(w))
    return g.groupBy("movie", "track_id", "island").agg(F.min("t").alias("t_start"), F.max("t").alias("t_end")).drop("island")


@query(_RUNS + "select a.movie, a.track_id as tail, b.track_id as head, a.t_end, b.t_start, (b.t_start - a.t_end)::int as gap from s a join s b on a.movie = b.movie and b.t_start > a.t_end and b.t_start <= a.t_end + 4")
def tracklet_gaps(spark, sf_dir):
    s = _segments(spark, sf_dir)
    return joins.gap_pairs(s, s, ["movie"], "t_end", "t_start", 4).select("tail.movie", F.col("tail.track_id").alias("tail"), F.col("head.track_id").alias("head"), "tail.t_end", "head.t_start", "gap")


@query(_DET + ", c as (select distinct movie, t as center_t from det where t % 5 = 0), f as (select distinct movie, t from det) select f.movie, f.t, arg_min(c.center_t, (abs(c.center_t - f.t), c.center_t))::bigint as center_t from f join c using (movie) group by f.movie, f.t")
def nearest_window_centre(spark, sf_dir):
    f = A.detections(spark, sf_dir).select("movie", "t").distinct()
    return joins.nearest_centre(f, f.filter("t % 5 = 0").withColumnRenamed("t", "center_t"), ["movie"], "t", "center_t")


@query(A.oracle("det", "flow") + ", s as (select movie, t, cell_id, least(greatest(round_even(cy / 12.5, 0), 0), 15)::int as y, least(greatest(round_even(cx / 12.5, 0), 0), 15)::int as x from det) select s.movie, s.t, s.cell_id, round(f.u, 6) as u, round(f.v, 6) as v from s join flow f on f.t0 = s.t and f.scale = 1 and f.y = s.y and f.x = s.x")
def sampled_field(spark, sf_dir):
    near = lambda c: F.least(F.greatest(F.bround(F.col(c) / 12.5), F.lit(0)), F.lit(15)).cast("int")
    d = A.detections(spark, sf_dir).select("movie", "t", "cell_id", near("cy").alias("y"), near("cx").alias("x"))
    f = A.fields(spark, sf_dir).filter("scale = 1").select(F.col("t0").alias("t"), "y", "x", "u", "v")
    return tidy(d.join(f, ["t", "y", "x"]).select("movie", "t", "cell_id", "u", "v"))


@query(_DET + ", a as (select movie, cell_id, count(*) as n_a from det where t < 15 group by all), b as (select movie, cell_id, count(*) as n_b from det where t >= 15 group by all) select movie, cell_id, coalesce(n_a, 0) as n_a, coalesce(n_b, 0) as n_b from a full join b using (movie, cell_id)")
def merged_features(spark, sf_dir):
    d = A.detections(spark, sf_dir)
    a, b = (d.filter(c).groupBy("movie", "cell_id").agg(F.count(F.lit(1)).alias(n)) for c, n in (("t < 15", "n_a"), ("t >= 15", "n_b")))
    return joins.merge_defaults(a, b, ["movie", "cell_id"], {"n_a": 0, "n_b": 0})


@query("select o_orderkey, o_custkey, coalesce(c_acctbal, -1.0) as balance from orders left join (select * from customer where c_mktsegment = 'BUILDING') on o_custkey = c_custkey")
def looked_up_balances(spark, sf_dir):
    """A lookup with a default for what is not found."""
    some = A.read(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("balance"))
    return joins.lookup(A.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), some, ["o_custkey"], "balance", -1.0).select("o_orderkey", "o_custkey", "balance")


@query(_DET + "select a.movie, a.t, a.cell_id from det a where not exists (select 1 from det b where b.movie = a.movie and b.cell_id = a.cell_id and b.t = a.t - 1)")
def births(spark, sf_dir):
    d = A.detections(spark, sf_dir).select("movie", "t", "cell_id")
    return d.join(d.withColumn("t", F.col("t") + 1), ["movie", "t", "cell_id"], "left_anti")


_NEAR = _DET + f", n as (select a.movie, a.track_id, a.t, min({_D2}) as d from track a join track b on a.movie = b.movie and a.t = b.t where {_D2} > 0.1 group by all)\n"


@query(_NEAR + "select movie, count(*) as n, round(quantile_cont(d, 0.5), 6) as median_nn from n group by movie")
def neighbour_distances(spark, sf_dir):
    p = A.track_points(spark, sf_dir)
    d = joins.nearest_distance(p, ["movie", "t"], ["movie", "track_id", "t"], ["y_um", "x_um"], 15.0, 0.1)
    return tidy(d.groupBy("movie").agg(F.count(F.lit(1)).alias("n"), F.percentile("d", F.lit(0.5)).alias("median_nn")))


_D3 = "(b.z_um - a.z_um) * (b.z_um - a.z_um) + (b.y_um - a.y_um) * (b.y_um - a.y_um) + (b.x_um - a.x_um) * (b.x_um - a.x_um)"


@query(_DET + f"select a.movie, a.track_id, a.t, arg_min(b.track_id, ({_D3}, b.track_id)) as nearest, round(sqrt(min({_D3})), 6) as d from track a join track b on a.movie = b.movie and a.t = b.t and a.track_id <> b.track_id group by a.movie, a.track_id, a.t")
def nearest_cells(spark, sf_dir):
    """Each cell's nearest other cell in its frame, however far; no radius is given."""
    p = A.track_points(spark, sf_dir)
    return tidy(adaptive.nearest_anywhere(p, p, ["movie", "t"], ["z_um", "y_um", "x_um"], ["movie", "track_id", "t"], "track_id", "track_id"))


_VEL = _DET + """, v as (select *, case when t - lag(t) over w = 1 then z_um - lag(z_um) over w end as vz_in, case when t - lag(t) over w = 1 then y_um - lag(y_um) over w end as vy_in, case when t - lag(t) over w = 1 then x_um - lag(x_um) over w end as vx_in,
        case when lead(t) over w - t = 1 then y_um - y_um + lead(y_um) over w - y_um end as vy_out, case when lead(t) over w - t = 1 then lead(x_um) over w - x_um end as vx_out
    from track window w as (partition by movie, track_id order by t))
"""


def _velocities(spark, sf_dir):
    w = Window.partitionBy("movie", "track_id").orderBy("t")
    p = A.track_points(spark, sf_dir)
    step = lambda c: F.when(F.col("t") - F.lag("t").over(w) == 1, F.col(c) - F.lag(c).over(w))
    ahead = lambda c: F.when(F.lead("t").over(w) - F.col("t") == 1, F.lead(c).over(w) - F.col(c))
    return p.select("*", step("z_um").alias("vz_in"), step("y_um").alias("vy_in"), step("x_um").alias("vx_in"), ahead("y_um").alias("vy_out"), ahead("x_um").alias("vx_out"))


@query(_VEL + "select movie, track_id, t, round(vy_in, 6) as vy_in, round(vx_in, 6) as vx_in, round(vy_out, 6) as vy_out, round(vx_out, 6) as vx_out from v")
def cell_velocities(spark, sf_dir):
    return tidy(_velocities(spark, sf_dir).select("movie", "track_id", "t", "vy_in", "vx_in", "vy_out", "vx_out"))


@query(_VEL + "select movie, count(*) as n, round(max(sqrt(vy_in * vy_in + vx_in * vx_in)), 6) as max_vxy from v where abs(vz_in) < 5 and sqrt(vy_in * vy_in + vx_in * vx_in) > 0.3 and sqrt(vy_in * vy_in + vx_in * vx_in) < 8 group by movie")
def plausible_velocities(spark, sf_dir):
    v = _velocities(spark, sf_dir).withColumn("vxy", F.sqrt(F.col("vy_in") * F.col("vy_in") + F.col("vx_in") * F.col("vx_in")))
    v = v.filter((F.abs("vz_in") < 5) & (F.col("vxy") > 0.3) & (F.col("vxy") < 8))
    return tidy(v.groupBy("movie").agg(F.count(F.lit(1)).alias("n"), F.max("vxy").alias("max_vxy")))


@query(_VEL + f", k as (select v.*, color_id from v join det using (movie, t, cell_id)) select a.movie, a.track_id, a.t, round(avg(b.vy_out), 6) + 0.0 as group_vy, round(avg(b.vx_out), 6) + 0.0 as group_vx, count(*) as n from k a join k b on a.movie = b.movie and a.t = b.t and a.color_id = b.color_id and a.track_id <> b.track_id and {_D2} < 20 where b.vy_out is not null group by all")
def group_velocity(spark, sf_dir):
    k = _velocities(spark, sf_dir).join(A.detections(spark, sf_dir).select("movie", "t", "cell_id", "color_id"), ["movie", "t", "cell_id"])
    near = joins.within(k, k.filter("vy_out is not null"), ["movie", "t", "color_id"], 20.0, ["y_um", "x_um"]).filter("d < 20 and a.track_id <> b.track_id")
    return tidy(near.groupBy("a.movie", "a.track_id", "a.t").agg(F.avg("b.vy_out").alias("group_vy"), F.avg("b.vx_out").alias("group_vx"), F.count(F.lit(1)).alias("n")))


@query(_LINKS + ", w as (select *, lead(t) over (partition by movie, track_id order by t) as t1 from k) select movie, t, count(*) as n_pairs, sum((exists (select 1 from enc where enc.movie = w.movie and enc.t = w.t and enc.a = w.track_id))::int)::bigint as n_hard from w where t1 = t + 1 group by movie, t")
def ground_truth_pairs(spark, sf_dir):
    w = Window.partitionBy("movie", "track_id").orderBy("t")
    pairs = _known(spark, sf_dir).withColumn("t1", F.lead("t").over(w)).filter("t1 = t + 1").select("movie", "track_id", "t")
    hard = _encounters(spark, sf_dir).select("a.movie", "a.track_id", "a.t").distinct().withColumn("hard", F.lit(1))
    return pairs.join(hard, ["movie", "track_id", "t"], "left").groupBy("movie", "t").agg(F.count(F.lit(1)).alias("n_pairs"), F.sum(F.coalesce("hard", F.lit(0))).cast("bigint").alias("n_hard"))


@query(_POINTS + "select before as from_color, coalesce(sum((color_id = 0)::int), 0)::bigint as to_0, coalesce(sum((color_id = 1)::int), 0)::bigint as to_1, coalesce(sum((color_id = 2)::int), 0)::bigint as to_2, coalesce(sum((color_id = 3)::int), 0)::bigint as to_3 from step where switch = 1 group by before")
def switch_matrix(spark, sf_dir):
    s = scoring.steps(coloured_points(spark, sf_dir)).filter("switch = 1")
    m = s.groupBy(F.col("before").alias("from_color")).pivot("color_id", [0, 1, 2, 3]).count()
    return m.select("from_color", *[F.coalesce(F.col(str(c)), F.lit(0)).alias(f"to_{c}") for c in range(4)])


@query(_POINTS + "select movie, t, sum(switch)::bigint as n_switches, count(before) as n_transitions, round(sum(switch) / nullif(count(before), 0)::double, 6) as rate from step group by movie, t")
def switch_rate_by_frame(spark, sf_dir):
    s = scoring.steps(coloured_points(spark, sf_dir)).groupBy("movie", "t").agg(F.sum("switch").cast("bigint").alias("n_switches"), F.count("before").alias("n_transitions"))
    return tidy(s.withColumn("rate", F.when(F.col("n_transitions") > 0, F.col("n_switches") / F.col("n_transitions"))))


@query(_POINTS + "select movie, t, round(continuity, 6) as continuity from cont order by continuity, movie, t limit 5")
def worst_frames(spark, sf_dir):
    return tidy(sweeps.top_rows(scoring.frame_continuity(coloured_points(spark, sf_dir)), [F.col("continuity"), "movie", "t"], 5).select("movie", "t", "continuity"))


@query(_DET + "select movie, color_id, count(*) as n_points, count(distinct cell_id) as n_tracks from det group by all")
def population_sizes(spark, sf_dir):
    return A.detections(spark, sf_dir).groupBy("movie", "color_id").agg(F.count(F.lit(1)).alias("n_points"), F.countDistinct("cell_id").alias("n_tracks"))


@query(_DET + ", n as (select movie, track_id, count(*) as n, max(t) - min(t) + 1 as span from track group by all) select movie, count(*) as n_tracks, sum((n >= 5)::int)::bigint as n_long, sum((n >= 0.8 * span)::int)::bigint as n_covered from n group by movie")
def track_retention(spark, sf_dir):
    n = A.track_points(spark, sf_dir).groupBy("movie", "track_id").agg(F.count(F.lit(1)).alias("n"), (F.max("t") - F.min("t") + 1).alias("span"))
    return n.groupBy("movie").agg(F.count(F.lit(1)).alias("n_tracks"), F.sum((F.col("n") >= 5).cast("bigint")).alias("n_long"), F.sum((F.col("n") >= 0.8 * F.col("span")).cast("bigint")).alias("n_covered"))


# ---- sweeps, splits and ranks -----------------------------------------------------------------------------------

_TRIAL = A.oracle("trial")


@query(_TRIAL + "select gate, weight, count(*) as n, round(avg(continuity), 6) as continuity, round(avg(switch_rate), 6) as switch_rate from trial group by all")
def sweep_means(spark, sf_dir):
    return tidy(sweeps.sweep_means(A.trials(spark, sf_dir), ["gate", "weight"], ["continuity", "switch_rate"]))


@query(_TRIAL + "select gate, weight, round(avg(continuity), 6) as continuity, count(*) as n from trial group by cube (gate, weight)")
def sweep_margins(spark, sf_dir):
    return tidy(sweeps.sweep_margins(A.trials(spark, sf_dir), "gate", "weight", "continuity"))


@query(_TRIAL + "select gate, " + ", ".join(f"round(avg(continuity) filter (weight = {w}), 6) as weight_{w}" for w in range(3)) + " from trial group by gate")
def sweep_heatmap(spark, sf_dir):
    return tidy(sweeps.sweep_heatmap(A.trials(spark, sf_dir), "gate", "weight", [0, 1, 2], "continuity"))


_COMBINED = _TRIAL + ", r as (select min(continuity) as c0, max(continuity) as c1, min(switch_rate) as s0, max(switch_rate) as s1 from trial), k as (select trial_id, gate, weight, continuity, switch_rate, ((case when c1 > c0 then (continuity - c0) / (c1 - c0) else 0.5 end) + (case when s1 > s0 then 1 - (switch_rate - s0) / (s1 - s0) else 0.5 end)) / 2 as combined from trial, r)\n"


@query(_COMBINED + "select trial_id, gate, weight, continuity, switch_rate, round(combined, 6) as combined from k")
def combined_scores(spark, sf_dir):
    return tidy(sweeps.combined_scores(A.trials(spark, sf_dir), ["continuity"], ["switch_rate"]))


@query(_COMBINED + "select trial_id, gate, weight, round(combined, 6) as combined from k order by round(combined, 6) desc, trial_id limit 10")
def top_trials(spark, sf_dir):
    c = tidy(sweeps.combined_scores(A.trials(spark, sf_dir), ["continuity"], ["switch_rate"])).select("trial_id", "gate", "weight", "combined")
    return sweeps.top_rows(c, [F.desc("combined"), "trial_id"], 10)


@query(_DET + ", r as (select movie, color_id = 0 as pos, rank() over (partition by movie order by n_vox) + (count(*) over (partition by movie, n_vox) - 1) / 2.0 as r from det), s as (select movie, sum(case when pos then r end) as r, sum(pos::int)::bigint as p, count(*) as n from r group by movie) select movie, round((r - p * (p + 1) / 2.0) / (p * (n - p)), 6) as auc, p, n from s")
def rank_auc(spark, sf_dir):
    d = A.detections(spark, sf_dir).select("movie", "n_vox", (F.col("color_id") == 0).alias("pos"))
    return tidy(sweeps.rank_auc(d, "n_vox", "pos", ["movie"]))


@query("select avg((p_size < p_retailprice / 40)::int) as win_fraction, count(*) as n from part")
def win_fraction(spark, sf_dir):
    p = A.read(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("a"), (F.col("p_retailprice") / 40).alias("b"))
    return sweeps.win_fraction(p, "a", "b")


@query(_DET + ", c as (select movie, n_vox, count(*) as n from det group by all) select movie, n_vox, n, round(sum(n) over (partition by movie order by n_vox) / sum(n) over (partition by movie)::double, 6) as cdf from c")
def size_cdf(spark, sf_dir):
    return tidy(sweeps.cdf(A.detections(spark, sf_dir), "n_vox", ["movie"]))


@query(_POINTS + ", runs as (select *, sum(switch) over (partition by movie, track_id order by t) as run, count(*) over (partition by movie, track_id) as known from step), l as (select count(*) as run_len from runs where known >= 2 group by movie, track_id, run) select least(run_len, 6)::bigint as bin, count(*) as n from l group by bin")
def run_length_histogram(spark, sf_dir):
    h = sweeps.capped_histogram(scoring.run_lengths(coloured_points(spark, sf_dir)), "run_len", 6)
    return h.select(F.col("bin").cast("bigint").alias("bin"), "n")


@query(_DET + ", f as (select movie, t, row_number() over (partition by movie order by t) - 1 as i, count(*) over (partition by movie) as n from (select distinct movie, t from det)) select movie, t from f where i in (select floor(j * (f.n - 1) / (least(f.n, 7) - 1))::bigint from range(7) r(j) where j < least(f.n, 7))")
def sampled_frames(spark, sf_dir):
    return sweeps.sample_frames(A.detections(spark, sf_dir), 7)


@query(_DET + ", f as (select movie, t, row_number() over (partition by movie order by t) as i, count(*) over (partition by movie) as n from (select distinct movie, t from det)) select movie, t, i <= floor(n * 0.8) as is_train from f")
def split_by_movie(spark, sf_dir):
    return sweeps.split_by_movie(A.detections(spark, sf_dir))


@query()
def sampled_sequences(spark, sf_dir):
    """Planes and starts drawn by a hash; the tests check their spacing and range."""
    planes = A.detections(spark, sf_dir).select("movie", "t", F.col("cz").cast("int").alias("z"))
    return sweeps.sample_sequences(planes, 3, 20)


@query(_DET + "select movie, t, cell_id from det where color_id in (0, 2) and t between 5 and 12")
def channel_and_time_slice(spark, sf_dir):
    return A.detections(spark, sf_dir).filter(F.col("color_id").isin(0, 2) & F.col("t").between(5, 12)).select("movie", "t", "cell_id")


@query(_POINTS + "select 'switches' as method, movie, round(sum(switches) / sum(transitions)::double, 6) as value from sw group by movie union all select 'continuity', movie, round(avg(continuity), 6) from cont group by movie")
def method_comparison(spark, sf_dir):
    rep = scoring.report(coloured_points(spark, sf_dir))
    a = rep.select(F.lit("switches").alias("method"), "movie", F.col("color_switch_rate").alias("value"))
    return tidy(a.unionByName(rep.select(F.lit("continuity").alias("method"), "movie", F.col("continuity_mean").alias("value"))))


# ---- tracking: grouped functions, tested against brute force ----------------------------------------------------


def _to_track(spark, sf_dir):
    d = A.detections(spark, sf_dir)
    return d.select("movie", "t", "cell_id", "color_id", *[(F.col(f"c{a}") * A.RESOLUTION[a]).alias(f"{a}_um") for a in "zyx"])


@query()
def track_sequence(spark, sf_dir):
    """Kalman tracks of every movie."""
    return tidy(tracking.track(_to_track(spark, sf_dir), ["movie"]))


def _per_frame(points):
    return points.groupBy("movie", "t").agg(F.count(F.lit(1)).alias("n_points"), F.countDistinct("track_id").alias("n_tracks"), F.countDistinct("cell_id").alias("n_cells"))


_PER_FRAME = "select movie, t, count(*) as n_points, count(*) as n_tracks, count(distinct cell_id) as n_cells from det"


@query(A.oracle("det") + _PER_FRAME + " group by movie, t")
def track_sequence_frames(spark, sf_dir):
    """Every detection of a frame is in a track, and in one of its own."""
    return _per_frame(tracking.track(_to_track(spark, sf_dir), ["movie"]))


@query(A.oracle("det") + _PER_FRAME + " where color_id >= 0 group by movie, t")
def track_population_frames(spark, sf_dir):
    """The same for tracks of each colour, whose ids never meet."""
    return _per_frame(tracking.track_populations(_to_track(spark, sf_dir)))


@query(A.oracle("det") + "select movie, t, count(*) as n_points, count(*) as n_tracks from det group by movie, t")
def stitched_tracklet_frames(spark, sf_dir):
    """Joining tracks over gaps never gives one track two points of a frame."""
    found = tracking.stitch_tracklets(tracking.track(_to_track(spark, sf_dir), ["movie"]))
    return found.groupBy("movie", "t").agg(F.count(F.lit(1)).alias("n_points"), F.countDistinct("stitched_id").alias("n_tracks"))


_KALMAN = A.oracle("det").replace("with ", "with recursive ", 1) + """, d as (select movie || '-' || cell_id::varchar as lane, row_number() over (partition by movie, cell_id order by t) as n, cz * 4.0::double as mz, cy * 0.48::double as my, cx * 0.48::double as mx from det),
    k as (
        select lane, n, 0::bigint as tid, mz as z, my as y, mx as x, 0.0::double as vz, 0.0::double as vy, 0.0::double as vx, 9.0::double as p00, 0.0::double as p01, 4.0::double as p11 from d where n = 1
        union all
        select lane, n, tid + (not hit)::bigint,
            case when hit then z + a00 / s * (mz - z) else mz end, case when hit then y + a00 / s * (my - y) else my end, case when hit then x + a00 / s * (mx - x) else mx end,
            case when hit then vz + a01 / s * (mz - z) else 0 end, case when hit then vy + a01 / s * (my - y) else 0 end, case when hit then vx + a01 / s * (mx - x) else 0 end,
            case when hit then a00 - a00 / s * a00 else 9 end, case when hit then a01 - a00 / s * a01 else 0 end, case when hit then a11 - a01 / s * a01 else 4 end
        from (select *, ((mz - z) * (mz - z) + (my - y) * (my - y) + (mx - x) * (mx - x)) / s <= 9.21 as hit from (
            select d.*, k.tid, k.z + k.vz as z, k.y + k.vy as y, k.x + k.vx as x, k.vz, k.vy, k.vx, k.p00 + 2 * k.p01 + k.p11 + 1 as a00, k.p01 + k.p11 as a01, k.p11 + 2 as a11, k.p00 + 2 * k.p01 + k.p11 + 10 as s
            from k join d on d.lane = k.lane and d.n = k.n + 1)))
    select lane as movie, n::int as t, tid as track_id from k"""


@query(_KALMAN)
def kalman_lanes(spark, sf_dir):
    """Tracks of single cells without gaps: predictions, gates and updates, as SQL computes them step by step."""
    w = Window.partitionBy("movie", "cell_id").orderBy("t")
    d = _to_track(spark, sf_dir).withColumn("t", F.row_number().over(w)).withColumn("movie", F.concat_ws("-", "movie", "cell_id"))
    return tracking.track(d, ["movie"], tracking.Config(max_gap=0)).select("movie", "t", "track_id")


@query()
def track_populations(spark, sf_dir):
    """Kalman tracks of every colour by itself."""
    return tidy(tracking.track_populations(_to_track(spark, sf_dir)))


@query()
def stitched_tracklets(spark, sf_dir):
    """Tracks joined over gaps of up to four frames."""
    return tidy(tracking.stitch_tracklets(tracking.track(_to_track(spark, sf_dir), ["movie"])))


@query()
def tracking_grid_search(spark, sf_dir):
    """Tracks under three gates, counted."""
    grid = spark.createDataFrame([(i, {"chi2_gate": g}) for i, g in enumerate((4.6, 9.21, 11.34))], "trial_id int, params map<string, double>")
    found = tracking.grid_search(_to_track(spark, sf_dir), grid)
    return found.groupBy("trial_id", "movie").agg(F.countDistinct("track_id").alias("n_tracks"), F.count(F.lit(1)).alias("n_points"))
