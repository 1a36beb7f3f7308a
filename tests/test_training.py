"""Training data, resolutions, other programs' tracks and the search of the segmenter's settings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtrail.operators import search, segmentation, training
from voxtrail.plans import catalog_training
from voxtrail.plans.catalog_kernels import _planes
from voxtrail.sources import volumes

SF = "/root/testdata/sf0.01"


def test_variance_loss_equals_numpy(spark):
    rng = np.random.default_rng(0)
    met, emb = rng.random((16, 16, 3)), rng.standard_normal((16, 16, 4))
    rows = [("m", 0, 0, y, x, met[y, x].tolist(), emb[y, x].tolist()) for y in range(16) for x in range(16)]
    df = spark.createDataFrame(rows, "movie string, t int, z int, y int, x int, metrics array<double>, emb array<double>")
    got = training.variance_loss(df, side=8, max_tiles=8, max_pixels=32, k=5).first()
    losses = []
    for ty in range(2):
        for tx in range(2):
            m, e = (a[8 * ty : 8 * ty + 8, 8 * tx : 8 * tx + 8].reshape(64, -1)[::2] for a in (met, emb))
            m, e = m / np.linalg.norm(m, axis=1, keepdims=True), e / np.linalg.norm(e, axis=1, keepdims=True)
            far = np.argsort(np.linalg.norm(m[:, None] - m[None], axis=2), 1)[:, -5:]
            losses.append(np.maximum(0.5 + np.take_along_axis(e @ e.T, far, 1), 0).mean())
    assert got.n_tiles == 4 and got.loss == pytest.approx(np.mean(losses))
    assert training.variance_loss(df, side=8, max_tiles=2).first().n_tiles == 2


def test_variance_loss_takes_all_tiles_and_pixels(spark):
    rng = np.random.default_rng(1)
    met, emb = rng.random((4, 1152, 3)), rng.standard_normal((4, 1152, 4))  # 32 x 36 pixels are a whole tile and a part of one
    rows = [("m", t, 0, y, x, met[t, 36 * y + x].tolist(), emb[t, 36 * y + x].tolist()) for t in range(2) for y in range(32) for x in range(36)]
    df = spark.createDataFrame(rows, "movie string, t int, z int, y int, x int, metrics array<double>, emb array<double>")
    for r in training.variance_loss(df).collect():
        m, e = (a[r.t].reshape(32, 36, -1)[:, :32].reshape(1024, -1) for a in (met, emb))
        m, e = m / np.linalg.norm(m, axis=1, keepdims=True), e / np.linalg.norm(e, axis=1, keepdims=True)
        far = np.argsort(((m[:, None] - m[None]) ** 2).sum(2), 1)[:, -10:]
        assert r.n_tiles == 1 and r.loss == pytest.approx(np.maximum(0.5 + np.take_along_axis(e @ e.T, far, 1), 0).mean())
    assert {r.n_tiles for r in training.variance_loss(df, side=8).collect()} == {16}
    planes = catalog_training.variance_repulsion(spark, "/root/testdata/sf0.001")
    assert {r.n_tiles for r in planes.collect()} == {4}


def test_shuffled_split_is_no_prefix_and_keeps_the_share(spark):
    frames = spark.range(40).select(F.lit("a").alias("movie"), F.col("id").cast("int").alias("t"))
    got = {r.t: r.is_train for r in training.shuffled_split(frames, 0.75).collect()}
    assert sum(got.values()) == 30 and not all(got[t] for t in range(30))
    assert got != {r.t: r.is_train for r in training.shuffled_split(frames, 0.75, seed=5).collect()}


def test_external_tracks_without_dummies(spark):
    cells = spark.createDataFrame([("m", t, 5, 0.0, float(t), 1.0) for t in range(4)], "movie string, t int, cell_id int, z_um double, y_um double, x_um double")
    links = spark.createDataFrame([("m", 1, 0, 5), ("m", 1, 1, -1), ("m", 1, 2, 5), ("m", 2, 3, 5), ("m", 3, 0, 9), ("m", 3, 1, 5)], "movie string, track_id long, t int, ref int")
    assert sorted((r.track_id, r.t) for r in training.from_external(links, cells).collect()) == [(1, 0), (1, 2)]


def test_pyramid_means(spark):
    a = np.arange(36.0).reshape(6, 6)
    df = spark.createDataFrame([("m", y, x, float(a[y, x])) for y in range(6) for x in range(6)], "movie string, y int, x int, v double")
    got = {(r.y, r.x): r.v for r in volumes.level(volumes.pyramid(df, 3), 1).collect()}
    assert got == {(y, x): a[2 * y : 2 * y + 2, 2 * x : 2 * x + 2].mean() for y in range(3) for x in range(3)}
    assert volumes.pyramid(df, 1).count() == 36


def test_segmentation_search_never_ends_below_its_trials(spark):
    planes = _planes(spark, SF).filter("t < 2").cache()
    voxels = catalog_training.channel_voxels(spark, SF).filter("t < 2").cache()
    base = segmentation.Parameters(seed_size=5, min_size=3)
    best, history = search.optimise_segmentation(planes, voxels, ["v0", "v1"], max_evals=8, fixed={"merge_affinity": 0.6}, base=base, min_size=10, purity=0.55)
    assert len(history) >= 8 and "merge_affinity" not in best
    scores = search.segmentation_scores(planes, voxels, ["v0", "v1"], [{**best, "merge_affinity": 0.6}, {"prob_threshold": 0.99}], base, min_size=10, purity=0.55)
    assert scores[0] == pytest.approx(max(s for _, s in history)) and scores[1] == 0.0
    at = [search.SEGMENTATION_BOUNDS[k] for k in best]
    assert all(low <= best[k] <= high for k, (low, high) in zip(best, at))


def test_colour_keeps_crossing_tracks_from_switching(spark):
    rows = [("m", t, c, c - 1, 0.0, (4.0 - t if c == 1 else t - 4.0) + 50.0 * k, 0.0) for t in range(8) for k in range(3) for c in (1, 2)]
    rows = [(m, t, c + 10 * k, colour, z, y, x) for (m, t, c, colour, z, y, x), k in zip(rows, [k for _ in range(8) for k in range(3) for _ in (1, 2)])]
    df = spark.createDataFrame(rows, "movie string, t int, cell_id int, color_id int, z_um double, y_um double, x_um double")
    got = {r.w_color: (r.switch_rate, r.continuity) for r in catalog_training.colour_weights(df, [0.0, 2.0]).collect()}
    assert got.keys() == {0.0, 2.0} and got[2.0][0] <= got[0.0][0] and got[2.0][0] < 0.2 and got[2.0][1] > 0.8
