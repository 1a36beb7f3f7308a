"""Views of the benchmark tables as detections, tracks, voxels, label maps, fields and embeddings.

The benchmark data have no images.  These adapters give the engine's canonical schemas
(README, "Data model") from its relational tables by integer arithmetic only, so
that another SQL engine computes the same rows; ORACLE holds that SQL, view by view.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxtrail.functions.windows import latest

#: µm per voxel, and the colours of event kinds; -1 is dim.
RESOLUTION = {"z": 4.0, "y": 0.48, "x": 0.48}
COLOURS = {"view": 0, "click": 1, "purchase": 2, "signup": 3}
#: Pixels of a plane's side, and frames of a movie of images; frames are numbered on from movie to movie.
GRID = 16
FRAMES = 24
PLANE = GRID * GRID


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame_of(ts: Column) -> Column:
    """The frame of a time: its day's number."""
    return F.datediff(F.to_date(ts), F.lit("2024-01-01").cast("date"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections from `events`: a user's last event of a day is a cell in that frame; five movies."""
    return detections_of(read(spark, sf_dir, "events"))


def detections_of(events: DataFrame) -> DataFrame:
    """Detections of rows of `events`."""
    e = events.select("event_id", "ts", "user_id", "event_type", "value")
    e = latest(e.withColumn("t", frame_of(F.col("ts"))), ["user_id", "t"], [F.desc("ts"), F.desc("event_id")])
    colour = F.lit(-1)
    for kind, number in COLOURS.items():
        colour = F.when(F.col("event_type") == kind, number).otherwise(colour)
    n, u = F.col("event_id"), F.col("user_id")
    return e.select(
        F.concat(F.lit("m"), (u % 5).cast("string")).alias("movie"),
        F.col("t").cast("int").alias("t"),
        u.cast("int").alias("cell_id"),
        (n % 5).cast("double").alias("cz"),
        ((u * 37 + n % 11) % 200).cast("double").alias("cy"),
        ((u * 53 + n % 13) % 200).cast("double").alias("cx"),
        (n % 400 + 20).cast("bigint").alias("n_vox"),
        colour.cast("int").alias("color_id"),
        F.col("value").cast("double").alias("intensity"),
    )


def track_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One track for each user, at its detections' places in µm."""
    d = detections(spark, sf_dir)
    return d.select("movie", F.col("cell_id").cast("bigint").alias("track_id"), "t", *[(F.col(f"c{a}") * RESOLUTION[a]).alias(f"{a}_um") for a in "zyx"], "cell_id")


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cloud of labelled voxels from `lineitem`, with three channels; label 0 is background."""
    l = read(spark, sf_dir, "lineitem")
    return l.select(
        F.lit("m0").alias("movie"),
        F.month("l_shipdate").cast("int").alias("t"),
        ((F.col("l_linenumber") - 1) % 8).cast("int").alias("z"),
        (F.col("l_orderkey") % 64).cast("int").alias("y"),
        (F.col("l_partkey") % 64).cast("int").alias("x"),
        (F.col("l_suppkey") % 40).cast("int").alias("label"),
        F.col("l_quantity").alias("v0"),
        (F.col("l_extendedprice") / 1000).alias("v1"),
        (F.col("l_discount") * 500).alias("v2"),
    )


def label_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two label maps over the same pixels: every line is a pixel with labels a and b."""
    return read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 17).cast("int").alias("a"), (F.col("l_partkey") % 13).cast("int").alias("b"))


def pixel_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of pixels with embeddings from `embeddings`; the fragment is its label."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pixel"), F.col("label").alias("fragment"), F.transform("embedding", lambda x: x.cast("double")).alias("emb"))


def _planes(table: DataFrame, key: str, value: str, sets: int) -> DataFrame:
    """Rows numbered by `key` as frames of `sets` planes: t, k (place in the frame) and `value`, null where the last frame has no row."""
    size = sets * PLANE
    frames = table.filter(F.col(key) % size == 0).select(F.floor(F.col(key) / size).cast("int").alias("t"), F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("k"))
    frames = frames.withColumn("__key", F.col("t").cast("long") * size + F.col("k"))
    rows = frames.join(table.select(F.col(key).alias("__key"), value), "__key", "left")
    place = [(F.col("k") % GRID).alias("x"), (F.floor(F.col("k") / GRID) % GRID).cast("int").alias("y"), F.floor(F.col("k") / PLANE).cast("int").alias("set")]
    return rows.select(F.concat(F.lit("m"), F.floor(F.col("t") / FRAMES).cast("string")).alias("movie"), "t", F.lit(0).alias("z"), *place, value)


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Displacement fields of `events` at scales 1, 2 and 4: outflow and rotation, moved on by each event's value.

    Events make planes of GRID x GRID pixels in order of their number; a pixel without one stays where it is.
    """
    p = _planes(read(spark, sf_dir, "events"), "event_id", "value", 3)
    scale = F.element_at(F.array(F.lit(1), F.lit(2), F.lit(4)), F.col("set") + 1)
    p = p.withColumn("scale", scale).withColumn("push", (F.floor(F.col("value") * 4) % 9 - 4) * 0.125)
    x, y, t, s = (F.col(c).cast("double") for c in ("x", "y", "t", "scale"))
    turn = (t % 6) * 0.5
    u = (x - 8) * s * 0.25 - (y - 5) * turn + F.col("push")
    v = (y - 8) * s * 0.25 + (x - 3) * turn + x * y * 0.0625 - F.col("push")
    return p.select("movie", F.col("t").alias("t0"), (F.col("t") + F.col("scale")).alias("t1"), "scale", "z", "y", "x", F.coalesce(u, F.lit(0.0)).alias("u"), F.coalesce(v, F.lit(0.0)).alias("v"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two channels of intensities from `orders`, a pattern that moves with time under each order's price; pixels without an order are dark."""
    p = _planes(read(spark, sf_dir, "orders"), "o_orderkey", "o_totalprice", 2)
    at = (F.col("x") * 7 + F.col("y") * 13 + F.col("t").cast("long") * 5 + F.col("set") * 29) % 31 + (F.col("x") * F.col("y")) % 5 * 8
    v = (at + F.floor("o_totalprice") % 16).cast("double")
    return p.select("movie", "t", "z", F.col("set").alias("c"), "y", "x", F.coalesce(v, F.lit(0.0)).alias("v"))


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sweep's results from `part`: two parameters and two metrics, of which the second is better when low."""
    p = read(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("trial_id"), (F.col("p_size") % 4).cast("int").alias("gate"), (F.col("p_partkey") % 3).cast("int").alias("weight"), (F.col("p_partkey") * 37 % 101 / 100).alias("continuity"), (F.col("p_size") / 50).alias("switch_rate"))


_COLOUR_SQL = " ".join(f"when '{k}' then {v}" for k, v in COLOURS.items())
#: The movie of frame t of a row f.
_MOVIE_SQL = f"'m' || (f.t // {FRAMES})::varchar"
ORACLE = {
    "det": f"""det as (
        select 'm' || (user_id % 5)::varchar as movie, t::int as t, user_id::int as cell_id, (event_id % 5)::double as cz,
            ((user_id * 37 + event_id % 11) % 200)::double as cy, ((user_id * 53 + event_id % 13) % 200)::double as cx,
            (event_id % 400 + 20)::bigint as n_vox, (case event_type {_COLOUR_SQL} else -1 end)::int as color_id, value::double as intensity
        from (select *, date_diff('day', date '2024-01-01', ts::date) as t,
                row_number() over (partition by user_id, date_diff('day', date '2024-01-01', ts::date) order by ts desc, event_id desc) as n from events)
        where n = 1)""",
    "track": "track as (select movie, cell_id::bigint as track_id, t, cz * 4.0::double as z_um, cy * 0.48::double as y_um, cx * 0.48::double as x_um, cell_id from det)",
    "voxel": """voxel as (
        select 'm0' as movie, month(l_shipdate)::int as t, ((l_linenumber - 1) % 8)::int as z, (l_orderkey % 64)::int as y, (l_partkey % 64)::int as x,
            (l_suppkey % 40)::int as label, l_quantity as v0, l_extendedprice / 1000 as v1, l_discount * 500 as v2 from lineitem)""",
    "pair": "pair as (select (l_suppkey % 17)::int as a, (l_partkey % 13)::int as b from lineitem)",
    "pixel_emb": "pixel_emb as (select vec_id as pixel, label as fragment, list_transform(embedding, lambda x: x::double) as emb from embeddings)",
    "flow": f"""flow as (
        select movie, t0, t0 + scale as t1, scale, 0 as z, y, x,
            coalesce((x::double - 8) * scale * 0.25 - (y::double - 5) * (t0 % 6) * 0.5 + push, 0.0) as u,
            coalesce((y::double - 8) * scale * 0.25 + (x::double - 3) * (t0 % 6) * 0.5 + x::double * y * 0.0625 - push, 0.0) as v
        from (select {_MOVIE_SQL} as movie, f.t::int as t0, (k % {GRID})::int as x, (k // {GRID} % {GRID})::int as y, ([1, 2, 4])[k // {PLANE} + 1]::int as scale, (floor(e.value * 4)::bigint % 9 - 4) * 0.125::double as push
            from (select event_id // {3 * PLANE} as t, unnest(range({3 * PLANE})) as k from events where event_id % {3 * PLANE} = 0) f left join events e on e.event_id = f.t * {3 * PLANE} + f.k))""",
    "pixel": f"""pixel as (
        select movie, t, 0 as z, c, y, x, coalesce(((x * 7 + y * 13 + t::bigint * 5 + c * 29) % 31 + (x * y) % 5 * 8 + price % 16)::double, 0.0) as v
        from (select {_MOVIE_SQL} as movie, f.t::int as t, (k % {GRID})::int as x, (k // {GRID} % {GRID})::int as y, (k // {PLANE})::int as c, floor(o.o_totalprice)::bigint as price
            from (select o_orderkey // {2 * PLANE} as t, unnest(range({2 * PLANE})) as k from orders where o_orderkey % {2 * PLANE} = 0) f left join orders o on o.o_orderkey = f.t * {2 * PLANE} + f.k))""",
    "trial": "trial as (select p_partkey as trial_id, (p_size % 4)::int as gate, (p_partkey % 3)::int as weight, (p_partkey * 37 % 101) / 100.0::double as continuity, p_size / 50.0::double as switch_rate from part)",
}


def oracle(*views: str) -> str:
    """The start of a query that uses these views, in order."""
    return "with " + ",\n".join(ORACLE[v] for v in views) + "\n"
