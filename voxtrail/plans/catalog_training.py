"""Queries of training data, of resolutions, of other programs' tracks and of the segmenter's settings."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from voxtrail import adapters as A, sql
from voxtrail.operators import analytics, joins, linking, motion, scoring, search, segmentation, tiles, tracking, training
from voxtrail.plans.catalog import _DET, _PIX, _POINTS, _to_track, coloured_points, query, tidy
from voxtrail.plans.catalog_kernels import _planes
from voxtrail.session import pin, shared_folder
from voxtrail.sources import chunks, volumes


@query(_DET + ", f as (select distinct movie, t from det), n as (select *, row_number() over (partition by movie order by ((t + 1)::bigint * 2654435761) % 4294967296, t) as i, count(*) over (partition by movie) as n from f) select movie, t, i <= floor(n * 0.8) as is_train from n")
def shuffled_split(spark, sf_dir):
    return training.shuffled_split(A.detections(spark, sf_dir))


@query(
    _DET
    + """, s as (select movie, track_id, t, z_um - lag(z_um) over w as dz, y_um - lag(y_um) over w as dy, x_um - lag(x_um) over w as dx from track window w as (partition by movie, track_id order by t)),
    k as (select *, pow(0.8, count(*) over (partition by movie, track_id) - row_number() over (partition by movie, track_id order by t)) as w from s where dz is not null)
    select movie, track_id, round(sum(w * dz) / sum(w), 6) as vz, round(sum(w * dy) / sum(w), 6) as vy, round(sum(w * dx) / sum(w), 6) as vx from k group by movie, track_id"""
)
def momentum_velocities(spark, sf_dir):
    return tidy(training.momentum_velocity(A.track_points(spark, sf_dir)))


@query(_DET + ", l as (select movie, track_id, t, cell_id, z_um, y_um, x_um, count(*) over (partition by movie, track_id) as n from track where (cell_id + t) % 3 <> 0) select movie, track_id, t, cell_id, z_um, round(y_um, 6) as y_um, round(x_um, 6) as x_um from l where n >= 2")
def external_tracks(spark, sf_dir):
    """Tracks as another program gives them, a third of whose points are dummies."""
    p = A.track_points(spark, sf_dir)
    links = p.select("movie", "track_id", "t", F.when((F.col("cell_id") + F.col("t")) % 3 == 0, -1).otherwise(F.col("cell_id")).alias("ref"))
    return tidy(training.from_external(links, p))


@query(
    A.oracle("flow", "pixel")
    + """, b as (select movie, t, z, y, x, avg(v) as i, max(v) as bright from pixel group by all),
    m as (select t0, z, y, x, sum(case when scale in (1, 2) then sqrt(u * u + v * v) end) as mag, max(case when scale = 1 then u end) as u, max(case when scale = 1 then v end) as v from flow group by all),
    s as (select b.movie, b.t, b.z, b.y, b.x, i + bright + coalesce(mag, 0) as total, case when mag is null then 2 else 4 end as n_inputs, m.u, m.v from b left join m on m.t0 = b.t and m.z = b.z and m.y = b.y and m.x = b.x)
    select s.movie, s.t, s.y, s.x, s.n_inputs, round(s.total, 6) as total, round(case when s.u is not null then n.total end, 6) as next_total, case when n.t is not null then s.u end as u, case when n.t is not null then s.v end as v
    from s left join s n on n.movie = s.movie and n.t = s.t + 1 and n.z = s.z and n.y = s.y and n.x = s.x"""
)
def assembled_pixels(spark, sf_dir):
    """Inputs of every pixel with those of the next frame, as a sum of four."""
    flow, pixels = A.fields(spark, sf_dir), A.pixels(spark, sf_dir)
    at = ["movie", "t", "z", "y", "x"]
    temporal = motion.magnitudes(flow.filter("scale in (1, 2)")).select("movie", F.col("t0").alias("t"), "z", "y", "x", F.concat(F.lit("mag_"), F.col("scale")).alias("name"), F.col("mag").alias("value"))
    variance = pixels.groupBy(*at).agg(F.max("v").alias("value")).withColumn("name", F.lit("bright"))
    out = training.assemble(pixels, temporal, variance, flow)
    total = lambda c: F.when(F.col(c).isNotNull(), F.aggregate(c, F.lit(0.0), lambda s, x: s + x))
    return tidy(out.select("movie", "t", "y", "x", F.size("inputs").alias("n_inputs"), total("inputs").alias("total"), total("next_inputs").alias("next_total"), "u", "v"))


@query(_PIX + "select movie, t, z, c, l::int as level, (y // (1 << l))::int as y, (x // (1 << l))::int as x, round(avg(v), 6) as v from pixel cross join range(3) r(l) group by all")
def pyramid_levels(spark, sf_dir):
    return tidy(volumes.pyramid(A.pixels(spark, sf_dir), 3))


@query(_PIX + "select movie, t, z, c, (y // 4)::int as y, (x // 4)::int as x, round(avg(v), 6) as v from pixel group by all")
def pyramid_level(spark, sf_dir):
    return tidy(volumes.level(volumes.pyramid(A.pixels(spark, sf_dir), 3), 2))


@query(_PIX + "select movie, t, z, c, (y // 2)::int as y, (x // 2)::int as x, round(avg(v), 6) as v from pixel where c = 1 group by all")
def chunk_store_level(spark, sf_dir):
    """A channel at half resolution, from a store of chunks at three levels that this writes first."""
    path = f"{shared_folder(spark)}/chunks-{uuid.uuid4().hex}"
    chunks.write(A.pixels(spark, sf_dir), path, levels=3, side=8)
    return tidy(chunks.read(spark, path, side=8, level=1, channels=[1]))


@query(
    _POINTS
    + """, n as (select a.movie, a.track_id, a.t, min(sqrt((a.y_um - b.y_um) * (a.y_um - b.y_um) + (a.x_um - b.x_um) * (a.x_um - b.x_um))) as d from track a join track b on a.movie = b.movie and a.t = b.t
        where sqrt((a.y_um - b.y_um) * (a.y_um - b.y_um) + (a.x_um - b.x_um) * (a.x_um - b.x_um)) > 0.1 group by all)
    select movie, coalesce(switch, 0)::int as is_switch, count(*) as n, round(quantile_cont(d, 0.5), 6) as median_nn from n left join step using (movie, track_id, t) group by movie, is_switch"""
)
def switch_site_distances(spark, sf_dir):
    """How far the nearest neighbour is where a track changes its colour, and elsewhere."""
    near = joins.nearest_distance(A.track_points(spark, sf_dir), ["movie", "t"], ["movie", "track_id", "t"], ["y_um", "x_um"], 15.0, 0.1)
    sites = scoring.steps(coloured_points(spark, sf_dir)).select("movie", "track_id", "t", "switch")
    rows = near.join(sites, ["movie", "track_id", "t"], "left").withColumn("is_switch", F.coalesce("switch", F.lit(0)))
    return tidy(rows.groupBy("movie", "is_switch").agg(F.count(F.lit(1)).alias("n"), F.percentile("d", F.lit(0.5)).alias("median_nn")))


#: Three settings of the segmenter, from one that joins little to one that joins much.
SETTINGS = {
    "strict": {"affinity": 0.8, "merge_affinity": 0.8, "merge_distance": 0.5, "merge_brightness": 0.8, "prob_weight": 0.0},
    "loose": {"affinity": 0.2, "merge_affinity": 0.2, "merge_distance": 3.0, "merge_brightness": 0.2, "prob_weight": 0.8},
    "current": {"affinity": 0.6, "merge_affinity": 0.7, "merge_distance": 1.0, "merge_brightness": 0.7, "prob_weight": 0.4},
}


def channel_voxels(spark, sf_dir) -> DataFrame:
    """The channels of each pixel, as two columns."""
    at = ["movie", "t", "z", "y", "x"]
    return A.pixels(spark, sf_dir).groupBy(*at).pivot("c", [0, 1]).agg(F.first("v")).withColumnsRenamed({"0": "v0", "1": "v1"})


@query()
def segmentation_settings(spark, sf_dir):
    """The purity score of three settings of the segmenter."""
    base = segmentation.Parameters(seed_size=5, prob_threshold=0.5, min_size=3)
    scores = search.segmentation_scores(_planes(spark, sf_dir), channel_voxels(spark, sf_dir), ["v0", "v1"], list(SETTINGS.values()), base, min_size=10, purity=0.55)
    return tidy(spark.createDataFrame(list(zip(SETTINGS, map(float, scores))), "setting string, score double"))


@query()
def variance_repulsion(spark, sf_dir):
    """The repulsion term of every plane, by all of its tiles of eight pixels."""
    p = _planes(spark, sf_dir).join(channel_voxels(spark, sf_dir), ["movie", "t", "z", "y", "x"]).withColumn("metrics", F.array("v0", "v1"))
    return tidy(training.variance_loss(p, side=8))


@query(_PIX + ", q as (select t, quantile_cont(v, 0.01) as a, quantile_cont(v, 0.99) as b from pixel where c = 0 group by t) select movie, t, z, y, x, round((v - a) / (b - a) * 2 + 1, 6) as v from pixel join q using (t) where c = 0")
def restored_planes(spark, sf_dir):
    """The whole chain around a restoring model, which here doubles values and adds one."""
    planes = A.pixels(spark, sf_dir).filter("c = 0").drop("c")
    return tidy(tiles.restore(planes, lambda t: t.withColumn("v", F.col("v") * 2 + 1), A.GRID, A.GRID, 24))


@query(
    _DET
    + """, s as (select movie, cell_id, t, coalesce((t - lag(t) over w > 2)::int, 0) as cut from det window w as (partition by movie, cell_id order by t)),
    r as (select *, sum(cut) over (partition by movie, cell_id order by t) as run from s)
    select movie || '-' || cell_id::varchar as movie, min(t) over (partition by movie, cell_id, run)::bigint * 4294967296 + cell_id as track_id, t, cell_id from r"""
)
def global_lanes(spark, sf_dir):
    """Cheapest sets of tracks where every cell has a movie of its own: a link is dear only if it leaves out two frames."""
    d = _to_track(spark, sf_dir)
    return linking.link_globally(d.withColumn("movie", F.concat_ws("-", "movie", "cell_id")), 1000.0, max_gap=1, birth=0.5, death=0.5)


@query()
def global_links_against_truth(spark, sf_dir):
    """Links of the known tracks that the cheapest set of tracks of each movie kept, broke or gave to another cell."""
    found = linking.link_globally(_to_track(spark, sf_dir), 6.0)
    return analytics.compare_links(analytics.links(A.track_points(spark, sf_dir)), analytics.links(found))


@query(_POINTS + "select movie, track_id, switches, transitions, dominant_color from sw")
def switches_in_sql(spark, sf_dir):
    """Switches of colour and dominant colours of tracks, written in SQL with the library's functions."""
    sql.register(spark)
    text = """select movie, track_id, color_switches(p) as switches, color_known(p) - 1 as transitions, dominant_color(p) as dominant_color
        from (select movie, track_id, collect_list(struct(t, color_id as color)) as p from {points} group by movie, track_id) where color_known(p) >= 2"""
    return spark.sql(text, points=coloured_points(spark, sf_dir))


@query(_PIX + ", s as (select unnest([0, 4])::int as start) select movie, t, y, x, count(*) as n_tiles, round(avg(v), 6) as v from pixel join s a on y between a.start and a.start + 11 join s b on x between b.start and b.start + 11 where c = 0 group by all")
def tiles_in_sql(spark, sf_dir):
    """How many tiles each pixel is in and the mean of its values there, with a table function."""
    sql.register(spark)
    text = """select movie, t, y, x, count(*) as n_tiles, avg(v) as v from {pixels}, lateral tile_starts(16, 12, 0.1D) a, lateral tile_starts(16, 12, 0.1D) b
        where c = 0 and y between a.start and a.start + 11 and x between b.start and b.start + 11 group by movie, t, y, x"""
    return tidy(spark.sql(text, pixels=A.pixels(spark, sf_dir)))


def colour_weights(detections: DataFrame, weights: list[float]) -> DataFrame:
    """Switch rate and mean continuity of the tracker's tracks under each weight of colour; detections (movie, t, cell_id, color_id, places)."""
    own = [(F.col("color_id") == c).cast("int").cast("double").alias(n) for c, n in enumerate("rgb")]
    seen = detections.select("*", *own)
    grid = detections.sparkSession.createDataFrame([(i, {"w_color": w, "max_cost": 1.5 + w}) for i, w in enumerate(weights)], "trial_id int, params map<string,double>")
    found = tracking.grid_search(seen, grid).join(detections.select("movie", "t", "cell_id", "color_id"), ["movie", "t", "cell_id"])
    points = pin(found.select(F.concat_ws("/", "trial_id", "movie").alias("movie"), "track_id", "t", "color_id"))
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), F.substring_index("movie", "/", 1).cast("int") + 1).alias("w_color")
    switches = scoring.track_switches(points).groupBy(weight).agg((F.sum("switches") / F.sum("transitions")).alias("switch_rate"))
    steady = scoring.frame_continuity(points).groupBy(weight).agg(F.avg("continuity").alias("continuity"))
    return switches.join(steady, "w_color")


@query()
def colour_weight_sweep(spark, sf_dir):
    """The tracker under four weights of colour: fewer switches for less continuity."""
    return tidy(colour_weights(_to_track(spark, sf_dir), [0.0, 1.0, 2.0, 3.0]))
