"""Queries of failure analytics, and of the kernels that SQL cannot express."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtrail import adapters as A
from voxtrail.operators import analytics, flow, labels, motion, segmentation, shapes, tiled, tiles, tracking, vectors
from voxtrail.plans import motion_table
from voxtrail.plans.catalog import _DET, _GRAD, _VOX, _known, _to_track, query, tidy

_STEP = _DET + """, s as (select *, case when t - lag(t) over w = 1 then y_um - lag(y_um) over w end as vy, case when t - lag(t) over w = 1 then x_um - lag(x_um) over w end as vx,
        case when lead(t) over w - t = 1 then lead(y_um) over w end as ny, case when lead(t) over w - t = 1 then lead(x_um) over w end as nx
    from track window w as (partition by movie, track_id order by t))
"""
_COLOUR = ", k as (select s.*, [(color_id = 0)::int::double, (color_id = 1)::int::double, (color_id >= 2)::int::double + 0.1] as colour from s join det using (movie, t, cell_id))\n"
_DXY = "sqrt((b.y_um - a.y_um) * (b.y_um - a.y_um) + (b.x_um - a.x_um) * (b.x_um - a.x_um))"
_COS = "list_dot_product(a.colour, b.colour) / ((sqrt(list_dot_product(a.colour, a.colour)) + 1e-8) * (sqrt(list_dot_product(b.colour, b.colour)) + 1e-8))"


@query(
    _STEP
    + """, r as (select a.movie, a.track_id, a.t, arg_min({'y': b.y_um, 'x': b.x_um}, (sqrt((b.y_um - a.ny) * (b.y_um - a.ny) + (b.x_um - a.nx) * (b.x_um - a.nx)), b.track_id)) as m
        from s a join track b on a.movie = b.movie and b.t = a.t + 1 and a.track_id <> b.track_id
        where a.ny is not null and sqrt((b.y_um - a.ny) * (b.y_um - a.ny) + (b.x_um - a.nx) * (b.x_um - a.nx)) <= 20 group by all)
    select s.movie, count(*) as n, round(avg(((ny - (y_um + vy)) * (ny - (y_um + vy)) + (nx - (x_um + vx)) * (nx - (x_um + vx)) < (m.y - (y_um + vy)) * (m.y - (y_um + vy)) + (m.x - (x_um + vx)) * (m.x - (x_um + vx)))::int), 6) as persistence
    from s join r using (movie, track_id, t) where vy is not null group by s.movie"""
)
def velocity_persistence(spark, sf_dir):
    return tidy(analytics.velocity_persistence(A.track_points(spark, sf_dir)))


def _coloured(spark, sf_dir):
    c = F.col("color_id")
    one = lambda x: x.cast("int").cast("double")
    return _known(spark, sf_dir).withColumn("colour", F.array(one(c == 0), one(c == 1), one(c >= 2) + 0.1))


@query(_STEP + _COLOUR + f", p as (select a.movie, a.track_id, a.t, {_COS} as cos from k a join k b on a.movie = b.movie and b.t = a.t + 1 where {_DXY} <= 15) select movie, track_id, t, sum((cos > 0.8)::int)::bigint as n_positive, sum((cos < 0.2)::int)::bigint as n_negative, sum((cos <= 0.8 and cos >= 0.2)::int)::bigint as n_ambiguous from p group by all")
def candidate_classes(spark, sf_dir):
    k = _coloured(spark, sf_dir)
    return analytics.candidate_classes(k, k, 15.0)


@query(
    _STEP
    + _COLOUR
    + f""", p as (select a.movie, a.track_id, a.t, {_DXY} as d, sqrt((b.y_um - a.y_um - 0.5) * (b.y_um - a.y_um - 0.5) + (b.x_um - a.x_um + 0.25) * (b.x_um - a.x_um + 0.25)) as f, row_number() over (partition by a.movie, a.track_id, a.t order by {_COS} desc, {_DXY}, b.track_id) as n
        from k a join k b on a.movie = b.movie and b.t = a.t + 1 where {_DXY} <= 25 and {_COS} > 0.8)
    select movie, count(*) as n, round(quantile_cont(d, 0.5), 6) as naive_median, round(quantile_cont(f, 0.5), 6) as flow_median, round(avg((f < d)::int), 6) as improved, round(avg((f <= 16)::int), 6) as inside from p where p.n = 1 group by movie"""
)
def landing_zone(spark, sf_dir):
    k = _coloured(spark, sf_dir).withColumn("dy_um", F.lit(0.5)).withColumn("dx_um", F.lit(-0.25))
    return tidy(analytics.landing_zone(k, k, 25.0))


@query(_STEP + f"select a.movie, a.t, a.track_id, b.track_id as candidate, round({_DXY}, 6) as dist_xy, round(abs(b.z_um - a.z_um), 6) as dist_z, round(sqrt((b.y_um - a.y_um - coalesce(a.vy, 0)) * (b.y_um - a.y_um - coalesce(a.vy, 0)) + (b.x_um - a.x_um - coalesce(a.vx, 0)) * (b.x_um - a.x_um - coalesce(a.vx, 0))), 6) as residual, round(sqrt(coalesce(a.vy, 0) * coalesce(a.vy, 0) + coalesce(a.vx, 0) * coalesce(a.vx, 0)), 6) as speed, (a.track_id = b.track_id)::int as is_true from s a join track b on a.movie = b.movie and b.t = a.t + 1 where {_DXY} <= 12")
def pair_features(spark, sf_dir):
    return tidy(analytics.pair_features(A.track_points(spark, sf_dir), 12.0))


@query(_VOX + ", n as (select movie, t, y, x, count(distinct label) as k from voxel where label > 0 group by all) select movie, t, round(avg(k), 6) as mean_labels, max(k) as max_labels from n group by movie, t")
def label_density(spark, sf_dir):
    return tidy(analytics.label_density(A.voxels(spark, sf_dir)))


@query(
    _DET
    + """, p as (select movie, cell_id, t, color_id, row_number() over (partition by movie, cell_id order by t) as i from det),
    c as (select a.movie, a.cell_id, a.t, b.color_id as c, count(*) as n from p a join p b on a.movie = b.movie and a.cell_id = b.cell_id and abs(a.i - b.i) <= 2 where b.color_id >= 0 group by all),
    m as (select movie, cell_id, t, c, row_number() over (partition by movie, cell_id, t order by n desc, c) as k from c)
    select p.movie, p.cell_id::bigint as track_id, p.t, coalesce(m.c, -1) as majority from p left join m on m.movie = p.movie and m.cell_id = p.cell_id and m.t = p.t and m.k = 1"""
)
def majority_colour(spark, sf_dir):
    return analytics.majority_colour(_known(spark, sf_dir)).select("movie", "track_id", "t", "majority")


@query()
def tracker_against_truth(spark, sf_dir):
    """Links of the known tracks that the Kalman tracker kept, broke or gave to another cell."""
    found = tracking.track(_to_track(spark, sf_dir), ["movie"])
    return analytics.compare_links(analytics.links(A.track_points(spark, sf_dir)), analytics.links(found))


@query(
    _DET
    + """, k as (select track.movie, track_id, track.t, [(color_id = 0)::int::double, (color_id = 1)::int::double, (color_id >= 2)::int::double + 0.1] as colour from track join det using (movie, t, cell_id)),
    n as (select *, row_number() over (partition by movie, track_id order by t) as i, count(*) over (partition by movie, track_id) as m, sqrt(list_dot_product(colour, colour)) + 1e-12 as size from k),
    s as (select *, case when i = 1 then pow(0.9, m - 1) else 0.1 * pow(0.9, m - i) end / size as w from n)
    select movie, track_id, round(sum(w * colour[1]), 6) as c0, round(sum(w * colour[2]), 6) as c1, round(sum(w * colour[3]), 6) as c2 from s group by movie, track_id"""
)
def colour_averages(spark, sf_dir):
    """Moving averages of colours along tracks."""
    return analytics.colour_average(_coloured(spark, sf_dir), "colour").select("movie", "track_id", *[F.round(F.col("colour")[i], 6).alias(f"c{i}") for i in range(3)])


@query()
def stitched_slices(spark, sf_dir):
    """Labels of all slices after stitching over z and bridging gaps."""
    return segmentation.stitch(A.voxels(spark, sf_dir), 0.05)


def _planes(spark, sf_dir):
    """Probabilities and embeddings of pixels, for the segmenter."""
    p = A.pixels(spark, sf_dir).filter("c = 0")
    y, x = F.col("y").cast("double"), F.col("x").cast("double")
    prob = 0.5 + 0.45 * F.sin(y * 0.8) * F.cos(x * 0.6 + F.col("t"))
    return p.select("movie", "t", "z", "y", "x", prob.alias("prob"), F.array(F.cos(x * 0.3), F.sin(y * 0.3), F.lit(0.5)).alias("emb"))


@query()
def segmented_planes(spark, sf_dir):
    """Regions grown from seeds on every plane."""
    return segmentation.segment(_planes(spark, sf_dir), segmentation.Parameters(seed_size=5, min_size=3))


@query(
    A.oracle("pixel")
    + """, m as materialized (select movie, t, z, y, x, y::bigint * 4294967296 + x as id from pixel where c = 0 and v > 30),
    n as materialized (select a.movie, a.t, a.z, a.id as a, b.id as b from m a join m b on a.movie = b.movie and a.t = b.t and a.z = b.z and abs(a.y - b.y) + abs(a.x - b.x) = 1),
    reach as (
        with recursive r as (
            select movie, t, z, id, id as root from m union
            select n.movie, n.t, n.z, n.b, r.root from r join n on n.movie = r.movie and n.t = r.t and n.z = r.z and n.a = r.id where r.root < n.b)
        select movie, t, z, id, min(root) as region from r group by all)
    select m.movie, m.t, m.z, m.y, m.x, reach.region from m join reach using (movie, t, z, id)"""
)
def tiled_regions(spark, sf_dir):
    """Regions of bright pixels, labelled in tiles of five pixels and united over their borders."""
    return tiled.regions(A.pixels(spark, sf_dir).filter("c = 0 and v > 30"), side=5)


@query()
def tiled_growth(spark, sf_dir):
    """Seeds grown in tiles of eight pixels that exchange halos of four."""
    return tiled.segment(_planes(spark, sf_dir), segmentation.Parameters(seed_size=5, min_size=3), side=8, halo=4)


@query()
def two_pass_segments(spark, sf_dir):
    """Large objects, then small ones where the first pass left bright pixels."""
    return segmentation.segment(_planes(spark, sf_dir), two_pass=True)


@query(
    _VOX
    + """, p as (select distinct movie, t, label, y, x from voxel where label > 0),
    q as (select movie, t, label, y + dy as y, x + dx as x, sum(w)::int as code from p cross join (values (0, 0, 8), (0, 1, 4), (1, 0, 2), (1, 1, 1)) o(dy, dx, w) group by all),
    b as (select *, code & 1 > 0 as b0, code & 2 > 0 as b1, code & 4 > 0 as b2, code & 8 > 0 as b3 from q),
    s as (select movie, t, label, sum(b3::int)::bigint as area, sum(case when code in (6, 9) then -2 when bit_count(code) = 1 then 1 when bit_count(code) = 3 then -1 else 0 end) / 4 as euler_number,
        pi() / 8 * (sum((b0 <> b1)::int) + sum((b0 <> b2)::int) + (sum((b0 <> b3)::int) + sum((b1 <> b2)::int)) / sqrt(2)) as perimeter_crofton from b group by all),
    edge as (select * from p where (select count(*) from p n where n.movie = p.movie and n.t = p.t and n.label = p.label and abs(n.y - p.y) + abs(n.x - p.x) = 1) < 4),
    line as (select a.movie, a.t, a.label, a.y, a.x, 1 + sum(case when abs(b.y - a.y) + abs(b.x - a.x) = 1 then 2 when abs(b.y - a.y) = 1 and abs(b.x - a.x) = 1 then 10 else 0 end) as code
        from edge a join edge b on a.movie = b.movie and a.t = b.t and a.label = b.label and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1 group by all),
    l as (select movie, t, label, sum(case when code in (5, 7, 15, 17, 25, 27) then 1 when code in (21, 33) then sqrt(2) when code in (13, 23) then (1 + sqrt(2)) / 2 else 0 end) as perimeter from line group by all)
    select movie, t, label, area, round(euler_number, 6) as euler_number, round(perimeter, 6) as perimeter, round(perimeter_crofton, 6) as perimeter_crofton from s join l using (movie, t, label)"""
)
def pattern_features(spark, sf_dir):
    """Area, Euler number and two perimeters of every projected cell, by patterns of neighbours."""
    return tidy(shapes.pattern_features(A.voxels(spark, sf_dir)))


@query()
def shape_features(spark, sf_dir):
    """All shape features of every projected cell."""
    return tidy(shapes.features(A.voxels(spark, sf_dir)))


@query()
def cell_outlines(spark, sf_dir):
    """The largest outline of every cell."""
    return tidy(shapes.outlines(A.voxels(spark, sf_dir), 1, 3).select("movie", "t", "label", "ring_area", F.size("ring").alias("n_points")))


@query()
def cell_morphology(spark, sf_dir):
    """Features and outlines together."""
    return tidy(shapes.morphology(A.voxels(spark, sf_dir)).drop("ring"))


@query()
def dense_optical_flow(spark, sf_dir):
    """Displacements between frames at two scales."""
    return tidy(flow.dense_flow(A.pixels(spark, sf_dir).filter("c = 0").select("movie", "t", "z", "y", "x", "v"), [1, 2]))


@query(A.oracle("pixel") + "select movie, t, z, y, x, round(v, 6) as v from pixel where c = 0")
def tiled_average(spark, sf_dir):
    p = A.pixels(spark, sf_dir).filter("c = 0")
    return tidy(tiles.average(tiles.tile(p, A.GRID, A.GRID, 12), "v", 12))


@query(
    A.oracle("det", "pixel")
    + """, c as (select movie, t, cell_id, (cy % 16)::int as y, (cx % 16)::int as x from det),
    g as (select c.movie, c.t, c.cell_id, p.y - c.y as dy, p.x - c.x as dx, max(p.v) as v from c join pixel p on p.t = c.t and p.c = 0 and p.y between c.y - 3 and c.y + 2 and p.x between c.x - 3 and c.x + 2 group by all),
    s as (select movie, t, cell_id, avg(v) as m, stddev_pop(v) as s from g group by all)
    select movie, t, cell_id, dy, dx, round((v - m) / (s + 1e-5), 6) as v from g join s using (movie, t, cell_id)"""
)
def patch_crops(spark, sf_dir):
    d = A.detections(spark, sf_dir).select("movie", "t", "cell_id", F.lit(0).alias("z"), (F.col("cy") % 16).cast("int").alias("y"), (F.col("cx") % 16).cast("int").alias("x"))
    planes = A.pixels(spark, sf_dir).filter("c = 0").drop("c").withColumn("movie", F.explode(F.array(*[F.lit(f"m{i}") for i in range(5)])))
    return tidy(segmentation.crops(planes, d, 3))


@query(
    A.oracle("pixel")
    + """, p as (select movie, t, y, x, c, v / 100.0::double as s from pixel), w as (select movie, t, y, x, avg(s) as whole, sum(s) as total, count(*) as n from p group by all)
    select 'channel ' || c::varchar as metric, round(avg(abs(whole - (total - s) / n)), 6) as importance from p join w using (movie, t, y, x) group by c"""
)
def channel_importance(spark, sf_dir):
    """How much a mean of channels changes where one of them is set to zero."""
    at = ["movie", "t", "y", "x"]
    p = A.pixels(spark, sf_dir).withColumn("s", F.col("v") / 100)
    full = p.groupBy(*at).agg(F.avg("s").alias("prob"), F.sum("s").alias("total"), F.count(F.lit(1)).alias("n"))
    left = p.join(full, at).select(*at, F.concat(F.lit("channel "), F.col("c").cast("string")).alias("metric"), ((F.col("total") - F.col("s")) / F.col("n")).alias("prob"))
    return tidy(analytics.ablation_importance(full, left, at))


@query()
def warp_consistency(spark, sf_dir):
    """Agreement of embeddings along displacements."""
    e = _planes(spark, sf_dir)
    return tidy(vectors.warp_consistency(e, e, A.fields(spark, sf_dir).filter("scale = 1")))


@query(
    A.oracle("voxel", "flow")
    + f""", g as (select *, {_GRAD.format(v="u", w="r")} as ux, {_GRAD.format(v="u", w="k")} as uy, {_GRAD.format(v="v", w="r")} as vx, {_GRAD.format(v="v", w="k")} as vy
        from flow where scale = 1 window r as (partition by movie, t0, y order by x), k as (partition by movie, t0, x order by y)),
    f as (select t0, z, y, x, u, v, sqrt(u * u + v * v) as mag, ux + vy as divergence, vx - uy as vorticity, sqrt(0.5 * ((ux - vy) * (ux - vy) + (uy + vx) * (uy + vx))) as strain from g)
    select a.movie, a.t, a.label, {", ".join(f"round(avg(f.{c}), 6) as {c}" for c in ("u", "v", "mag", "divergence", "vorticity", "strain"))}
    from voxel a join f on a.t = f.t0 and a.z = f.z and a.y = f.y and a.x = f.x where a.label > 0 group by all"""
)
def cell_flow_features(spark, sf_dir):
    """Six motion features of every cell: displacement, size, divergence, vorticity and strain."""
    field = motion.magnitudes(motion.deformation(A.fields(spark, sf_dir).filter("scale = 1"))).withColumnRenamed("t0", "t")
    return tidy(labels.mean_field(A.voxels(spark, sf_dir), field, ["u", "v", "mag", "divergence", "vorticity", "strain"]))


@query()
def motion_metrics(spark, sf_dir):
    """All named motion metrics of the movie."""
    frames = A.pixels(spark, sf_dir).filter("c = 0").drop("c")
    return tidy(motion_table.motion_metrics(A.fields(spark, sf_dir), frames, [1, 2, 4]))


@query()
def track_with_flow(spark, sf_dir):
    """Tracks with displacement fields in the costs."""
    f = A.fields(spark, sf_dir).filter("scale = 1").select("movie", F.col("t0").alias("t"), "y", "x", "u", "v")
    return tidy(tracking.track_with_flow(_to_track(spark, sf_dir), f, A.RESOLUTION))
