"""Rows that are listed under several keys are not sent through the driver, however small the tables look."""

import numpy as np
from pyspark.sql import functions as F

from voxtrail.operators import joins, segmentation


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def points(spark, n: int = 50):
    return spark.range(n).select(F.lit("m").alias("movie"), (F.col("id") % 3).cast("int").alias("t"), F.col("id").alias("track_id"), *[(F.col("id") * k % 20).cast("double").alias(f"{a}_um") for a, k in (("z", 3), ("y", 7), ("x", 11))])


def test_within_shuffles_small_tables(spark):
    p = points(spark)
    found = joins.within(p, p, ["movie", "t"], 6.0, ["z_um", "y_um", "x_um"])
    assert "BroadcastExchange" not in plan(found)
    rows = [tuple(r) for r in p.select("t", "track_id", "z_um", "y_um", "x_um").collect()]
    brute = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and sum((x - y) ** 2 for x, y in zip(a[2:], b[2:])) <= 36}
    assert {(r.a, r.b) for r in found.select(F.col("a.track_id").alias("a"), F.col("b.track_id").alias("b")).collect()} == brute


def test_gap_pairs_shuffle_small_tables(spark):
    s = spark.range(20).select(F.lit("m").alias("movie"), F.col("id").alias("t_start"), (F.col("id") + 1).alias("t_end"))
    found = joins.gap_pairs(s, s, ["movie"], "t_end", "t_start", 4)
    assert "BroadcastExchange" not in plan(found)
    assert found.count() == sum(min(4, max(0, 19 - (i + 1))) for i in range(20))


def test_crops_shuffle_small_tables(spark):
    pixels = spark.range(256).select(F.lit("m").alias("movie"), F.lit(0).alias("t"), F.lit(0).alias("z"), (F.col("id") / 16).cast("int").alias("y"), (F.col("id") % 16).cast("int").alias("x"), F.col("id").cast("double").alias("v"))
    centres = spark.range(3).select(F.lit("m").alias("movie"), F.lit(0).alias("t"), F.col("id").cast("int").alias("cell_id"), F.lit(0).alias("z"), F.lit(8).alias("y"), F.col("id").cast("int").alias("x"))
    got = plan(segmentation.crops(pixels, centres, 3))
    assert "BroadcastHashJoin" not in got.split("Generate")[0].rsplit("Aggregate", 1)[-1]
    assert segmentation.crops(pixels, centres, 3).count() == 6 * (3 + 4 + 5)


def test_rivals_of_a_crowd_are_searched_close_by(spark, monkeypatch):
    from voxtrail.operators import analytics

    p = spark.range(400).select(F.lit("m").alias("movie"), (F.col("id") % 2).cast("int").alias("t"), F.floor(F.col("id") / 2).alias("track_id"), *[(F.col("id") * k % 211 / 10).alias(f"{a}_um") for a, k in (("y", 37), ("x", 53))])
    asked, whole = [], joins.within
    monkeypatch.setattr(joins, "within", lambda left, right, keys, radius, dims: asked.append(radius) or whole(left, right, keys, radius, dims))
    monkeypatch.setattr(analytics, "within", joins.within)
    found = {(r.track_id, r.rival) for r in analytics.rivals(p, 20.0).collect()}
    assert asked[0] == 20.0 / joins.RINGS
    rows = p.collect()
    after = {r.track_id: r for r in rows if r.t == 1}
    brute = set()
    for i, own in after.items():
        d, j = min((((own.y_um - r.y_um) ** 2 + (own.x_um - r.x_um) ** 2) ** 0.5, k) for k, r in after.items() if k != i)
        if d <= 20:
            brute.add((i, j))
    assert found == brute


def crowd(spark, n: int = 240):
    colours = F.array(*[F.array(*map(F.lit, c)) for c in ((1.0, 0.0, 0.1), (0.0, 1.0, 0.1), (0.0, 0.0, 1.1))])
    p = spark.range(n).select(F.lit("m").alias("movie"), (F.col("id") % 3).cast("int").alias("t"), F.floor(F.col("id") / 3).alias("track_id"), *[(F.col("id") * k % 97 / 2).alias(f"{a}_um") for a, k in (("y", 37), ("x", 53))], F.element_at(colours, (F.floor(F.col("id") / 7) % 3 + 1).cast("int")).alias("colour"))
    return p.withColumn("dy_um", F.lit(0.5)).withColumn("dx_um", F.lit(-0.25))


def test_colour_matches_of_a_crowd_are_not_sorted_by_pairs(spark, monkeypatch):
    from voxtrail.operators import analytics

    def no_pairs(*_):
        raise AssertionError("pairs of rows were made")

    monkeypatch.setattr(analytics, "within", no_pairs)
    monkeypatch.setattr(joins, "PAIRS", 50)  # several blocks for each cell
    p = crowd(spark)
    rows = p.collect()
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / ((sum(x * x for x in a) ** 0.5 + 1e-8) * (sum(x * x for x in b) ** 0.5 + 1e-8))
    kinds, gaps = {}, []
    for a in rows:
        near = [(cos(a.colour, b.colour), ((a.y_um - b.y_um) ** 2 + (a.x_um - b.x_um) ** 2) ** 0.5, b) for b in rows if b.t == a.t + 1]
        near = [x for x in near if x[1] <= 12]
        if near:
            kinds[a.track_id, a.t] = (sum(c > 0.8 for c, _, _ in near), sum(c < 0.2 for c, _, _ in near), sum(0.2 <= c <= 0.8 for c, _, _ in near))
        alike = [(-c, d, b.track_id, b) for c, d, b in near if c > 0.8]
        if alike:
            _, d, _, b = min(alike, key=lambda x: x[:3])
            gaps.append((d, ((b.y_um - a.y_um - 0.5) ** 2 + (b.x_um - a.x_um + 0.25) ** 2) ** 0.5))
    found = analytics.candidate_classes(p, p, 12.0)
    assert {(r.track_id, r.t): (r.n_positive, r.n_negative, r.n_ambiguous) for r in found.collect()} == kinds
    (got,) = analytics.landing_zone(p, p, 12.0).collect()
    assert got.n == len(gaps)
    assert abs(got.naive_median - np.median([d for d, _ in gaps])) < 1e-9 and abs(got.flow_median - np.median([f for _, f in gaps])) < 1e-9
    assert abs(got.improved - np.mean([f < d for d, f in gaps])) < 1e-9


def test_labels_of_a_pixel_are_paired_once(spark):
    from voxtrail.operators import labels

    v = spark.range(3000).select(F.lit("m").alias("movie"), F.lit(0).alias("t"), (F.col("id") % 2).cast("int").alias("z"), (F.col("id") * 7 % 5).cast("int").alias("y"), (F.col("id") * 11 % 4).cast("int").alias("x"), F.floor(F.col("id") / 7 % 4).cast("int").alias("label"))
    rows = [(r.z, r.y, r.x, r.label) for r in v.collect() if r.label > 0]
    seen, touch = set(rows), {}
    for z, y, x, b in seen:
        for a in {a for z2, y2, x2, a in seen if z2 == z and abs(y2 - y) + abs(x2 - x) == 1 and a != b}:
            touch[z, a, b] = touch.get((z, a, b), 0) + 1
    found = labels.contacts(v)
    assert {(r.z, r.a, r.b): r.n_contact for r in found.collect()} == touch
    assert "collect_set" in plan(found)
    over = labels.slice_overlaps(v)
    above = {}
    for z, y, x, a in rows:
        if z == 0:
            for b in (r[3] for r in rows if r[:3] == (1, y, x)):
                above[a, b] = above.get((a, b), 0) + 1
    assert {(r.label, r.label_up): r.n for r in over.collect()} == above
    # Rows of one pixel and label are one row before the pairing.
    assert "k_up" in plan(over)
