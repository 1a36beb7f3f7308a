"""Failure analytics on hand-built tracks, and the catalogue as a whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from voxtrail.operators import analytics
from voxtrail.plans import motion_table
from voxtrail import adapters

SF = "/root/testdata/sf0.01"
POINTS = "movie string, track_id long, t int, z_um double, y_um double, x_um double"


def test_links_are_kept_broken_or_wrong(spark):
    truth = spark.createDataFrame([("m", 0, 1, 1), ("m", 0, 2, 2), ("m", 0, 3, 3)], "movie string, t int, cell_id int, next_cell_id int")
    found = spark.createDataFrame([("m", 0, 1, 1), ("m", 0, 2, 3)], "movie string, t int, cell_id int, next_cell_id int")
    got = {r.outcome: r.n for r in analytics.compare_links(truth, found).collect()}
    assert got == {"kept": 1, "wrong": 1, "broken": 1}


def test_persistent_tracks_go_where_their_velocity_leads(spark):
    rows = [("m", k, t, 0.0, 10.0 * k, 2.0 * t) for t in range(5) for k in (0, 1)]
    r = analytics.velocity_persistence(spark.createDataFrame(rows, POINTS)).first()
    assert r.persistence == 1.0 and r.n == 6


def test_pairs_can_be_told_apart(spark):
    rng = np.random.default_rng(0)
    rows = [("m", k, t, 0.0, 12.0 * k + float(rng.normal()), 2.0 * t) for t in range(8) for k in range(6)]
    pairs = analytics.pair_features(spark.createDataFrame(rows, POINTS), 30.0)
    model, scores = analytics.fit_pairs(pairs, ["dist_xy", "dist_z", "residual", "speed"])
    assert max(scores) > 0.9 and model.numFeatures == 4


def test_ablation_and_majority(spark):
    full = spark.createDataFrame([(0, 0.5), (1, 0.5)], "pixel int, prob double")
    less = spark.createDataFrame([(0, "a", 0.4), (1, "a", 0.7), (0, "b", 0.5), (1, "b", 0.5)], "pixel int, metric string, prob double")
    assert {r.metric: round(r.importance, 6) for r in analytics.ablation_importance(full, less, ["pixel"]).collect()} == {"a": 0.15, "b": 0.0}
    pts = spark.createDataFrame([("m", 1, t, c) for t, c in enumerate((0, 0, 1, 0, -1, 1, 1))], "movie string, track_id long, t int, color_id int")
    assert [r.majority for r in analytics.majority_colour(pts).orderBy("t").collect()] == [0, 0, 0, 0, 1, 1, 1]


def test_colour_average_folds_in_order(spark):
    pts = spark.createDataFrame([("m", 1, 0, [2.0, 0.0]), ("m", 1, 1, [0.0, 3.0])], "movie string, track_id long, t int, c array<double>")
    assert analytics.colour_average(pts, "c").first().colour == pytest.approx([0.9, 0.1])


def test_metric_table_has_all_names_in_range(spark):
    frames = adapters.pixels(spark, SF).filter("c = 0").drop("c")
    out = motion_table.motion_metrics(adapters.fields(spark, SF), frames, [1, 2]).groupBy("name").agg(F.min("value").alias("a"), F.max("value").alias("b")).collect()
    assert {r.name for r in out} == {"mag_1", "mag_2", "divergence", "vorticity", "strain", "flow_structure_alignment", "normal_flow", "tangential_flow", "edge_strength", "cumulative_mag", "cell_boundary_likelihood", "acceleration", "direction_stability"}
    assert all(-1e-9 <= r.a <= r.b <= 1 + 1e-9 for r in out)


def test_entry_and_catalogue(spark):
    assert __spark_entry__.entry(spark).count() > 0
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and len(oracles) > 80
