"""Displacement fields, blurs, tiles and search against analytic cases and numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtrail.operators import flow, labels, motion, scoring, search, sweeps, tiles, vectors
from voxtrail.sources import volumes


def field(spark, u, v, n=8):
    rows = [("m", 0, 1, 1, 0, y, x, float(u(y, x)), float(v(y, x))) for y in range(n) for x in range(n)]
    return spark.createDataFrame(rows, "movie string, t0 int, t1 int, scale int, z int, y int, x int, u double, v double")


@pytest.mark.parametrize("u,v,want", [(lambda y, x: x, lambda y, x: y, (2, 0, 0)), (lambda y, x: -y, lambda y, x: x, (0, 2, 0)), (lambda y, x: x, lambda y, x: -y, (0, 0, 2**0.5))])
def test_analytic_deformation(spark, u, v, want):
    for r in motion.deformation(field(spark, u, v)).collect():
        assert (r.divergence, r.vorticity, r.strain) == pytest.approx(want)


def test_translation_is_found():
    y, x = np.mgrid[:64, :64]
    blob = lambda cy, cx: sum(np.exp(-((y - a - cy) ** 2 + (x - b - cx) ** 2) / 30) for a, b in ((20, 20), (44, 30), (30, 48)))
    u, v = flow.farneback(blob(0, 0) * 200, blob(1.5, 2.0) * 200)
    bright = blob(0, 0) > 0.3
    assert np.abs(u[bright] - 2.0).mean() < 0.3 and np.abs(v[bright] - 1.5).mean() < 0.3


def test_dense_flow_rows(spark):
    y, x = np.mgrid[:32, :32]
    image = lambda c: 200 * np.exp(-((y - 16) ** 2 + (x - 14 - c) ** 2) / 40)
    rows = [("m", t, 0, int(a), int(b), float(image(t)[a, b])) for t in (0, 1) for a in range(32) for b in range(32)]
    df = spark.createDataFrame(rows, "movie string, t int, z int, y int, x int, v double")
    out = flow.dense_flow(df, [1]).toPandas()
    assert len(out) == 1024 and set(out.t1) == {1}
    assert out[(out.y == 16) & (out.x == 14)].u.iloc[0] == pytest.approx(1.0, abs=0.3)


def test_blur_reflects_at_borders(spark):
    rng = np.random.default_rng(0)
    a = rng.random((9, 11))
    rows = [("m", 0, 0, y, x, float(a[y, x])) for y in range(9) for x in range(11)]
    df = spark.createDataFrame(rows, "movie string, t int, z int, y int, x int, v double")
    got = np.zeros_like(a)
    for r in motion.blur(motion.blur(df, "x", ["v"], 2.0, 7), "y", ["v"], 2.0, 7).collect():
        got[r.y, r.x] = r.v
    k = np.exp(-(np.arange(-3, 4) ** 2) / 8)
    k /= k.sum()
    want = a
    for axis in (1, 0):
        p = np.pad(want, [(3, 3) if i == axis else (0, 0) for i in (0, 1)], mode="reflect")
        want = np.lib.stride_tricks.sliding_window_view(p, 7, axis) @ k
    assert np.allclose(got, want)


def test_normalisation_edges(spark):
    flat = spark.createDataFrame([("a", 3.0)] * 4, "k string, value double")
    assert {r.value for r in motion.normalise_metric(flat, ["k"]).collect()} == {0.0}
    assert {r.value for r in motion.normalise_range(flat, ["k"], "value").collect()} == {0.0}
    ramp = spark.createDataFrame([("a", i / 100) for i in range(10_001)], "k string, value double")
    out = motion.normalise_range(ramp, ["k"], "value").agg(F.min_by("value", F.abs("value")), F.max("value"), F.min("value")).first()
    assert out[0] == pytest.approx(0, abs=1e-3) and out[1] == pytest.approx(1.0102, abs=1e-3) and out[2] < 0


def test_tiles_average_back(spark):
    assert tiles.starts(100, 64) == [0, 36] and sum(tiles.padding(250)) + 250 == 272 and (300 + sum(tiles.padding(300))) % 16 == 0
    df = spark.createDataFrame([("m", 0, 0, y, x, float(y * 100 + x)) for y in range(0, 90, 7) for x in range(0, 100, 9)], "movie string, t int, z int, y int, x int, v double")
    back = tiles.average(tiles.tile(df, 90, 100, 64), "v", 64).join(df.withColumnRenamed("v", "w"), ["movie", "t", "z", "y", "x"])
    assert back.count() == df.count() and back.agg(F.max(F.abs(F.col("v") - F.col("w")))).first()[0] < 1e-9


def test_search_finds_the_top():
    best, history = search.maximise(lambda ts: [-((t["a"] - 0.3) ** 2) - (t["b"] - 7) ** 2 for t in ts], {"a": (0, 1), "b": (0, 10)}, 200)
    assert best["a"] == pytest.approx(0.3, abs=0.05) and best["b"] == pytest.approx(7, abs=0.3) and len(history) >= 200


def test_tracking_search_runs(spark):
    rows = [("m", t, c, c % 2, 0.0, 50.0 * c, 3.0 * t) for t in range(6) for c in range(3)]
    det = spark.createDataFrame(rows, "movie string, t int, cell_id int, color_id int, z_um double, y_um double, x_um double")
    best, history = search.optimise_tracking(det, 6, fixed={"w_color": 0.0})
    assert set(best) == set(search.TRACKING_BOUNDS) - {"w_color"} and max(s for _, s in history) == pytest.approx(0.0)


def test_perfect_and_switching_tracks(spark):
    def report(points):
        return scoring.report(spark.createDataFrame([("m", *p) for p in points], "movie string, track_id long, t int, color_id int")).first()

    r = report([(k, t, k) for k in (0, 1) for t in range(4)])
    assert r.continuity_mean == 1 and r.color_switch_rate == 0 and r.frag_max == 1
    r = report([(0, t, c) for t, c in enumerate((0, 0, 1, 1))])
    assert (r.n_switches, r.n_transitions, r.within_run, r.at_gap, r.mean_seg_len) == (1, 3, 1, 0, 2.0)
    assert report([(0, 0, 0), (0, 2, 1)]).at_gap == 1
    r = report([(0, 0, 0), (0, 1, -1), (0, 2, 0)])
    assert (r.n_transitions, r.n_switches) == (1, 0)
    r = report([(0, 0, 0), (0, 1, 0), (1, 1, 0), (1, 2, 0)])
    assert r.continuity_mean == 0.75


def test_iou_of_equal_and_partial_maps(spark):
    pairs = lambda rows: labels.jaccard(labels.overlaps(spark.createDataFrame(rows, "a int, b int"))).collect()
    assert pairs([(1, 1)] * 4 + [(0, 0)] * 12)[0].iou == 1.0
    assert pairs([(1, 0)] * 5 + [(1, 1)] * 5 + [(0, 1)] * 15 + [(0, 0)] * 5)[0].iou == pytest.approx(0.2)


def test_neighbours_match_numpy(spark):
    rng = np.random.default_rng(3)
    e = rng.standard_normal((40, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(e)], "p long, v array<double>")
    got = vectors.nearest_and_farthest(vectors.block_distances(df.withColumn("g", F.lit(1)), ["g"], "p", "v", 3), 4).collect()
    d = ((e[:, None] - e[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    near = {i: set(np.argsort(d[i])[:4].tolist()) for i in range(40)}
    np.fill_diagonal(d, -np.inf)
    far = {i: set(np.argsort(-d[i])[:4].tolist()) for i in range(40)}
    for i in range(40):
        assert {r.j for r in got if r.i == i and r["rank"] > 0} == near[i] and {r.j for r in got if r.i == i and r["rank"] < 0} == far[i]


def test_warp_consistency(spark):
    emb = "movie string, t int, z int, y int, x int, prob double, emb array<double>"
    a = spark.createDataFrame([("m", 0, 0, 0, 0, 0.9, [1.0, 0.0]), ("m", 0, 0, 0, 1, 0.1, [1.0, 0.0])], emb)
    b = spark.createDataFrame([("m", 1, 0, 0, 0, 0.9, [0.0, 1.0]), ("m", 1, 0, 0, 1, 0.9, [1.0, 0.0])], emb)
    f = spark.createDataFrame([("m", 0, 0, 0, x, 1.0, 0.0) for x in (0, 1)], "movie string, t0 int, z int, y int, x int, u double, v double")
    r = vectors.warp_consistency(a, b, f).first()
    assert r.n == 1 and r.warp_loss == pytest.approx(0, abs=1e-6)


def test_sampled_sequences(spark):
    planes = spark.createDataFrame([("m", t, z) for t in range(30) for z in range(9)], "movie string, t int, z int")
    got = sweeps.sample_sequences(planes, 3, 20).collect()
    assert [r.z for r in got] == [0, 4, 8] and all(0 <= r.t0 <= 10 for r in got)


def test_npy_source(spark, tmp_path):
    vol = np.zeros((2, 3, 4, 5), np.int32)
    vol[1, 2, 3, 4] = 7
    np.save(tmp_path / "movie1.npy", vol)
    assert [tuple(r) for r in volumes.read_npy(spark, str(tmp_path)).collect()] == [("movie1", 1, 2, 3, 4, 7)]


def test_planes_round_trip_and_slices(spark):
    df = spark.createDataFrame([("m", t, 0, y, x, float(x)) for t in (0, 1) for y in (0, 1) for x in (0, 1)], "movie string, t int, z int, y int, x int, v double")
    back = volumes.from_planes(volumes.to_planes(df))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert volumes.slice_volume(df.withColumn("c", F.lit(1)), t=(1, 1), channels=[1]).count() == 4


def test_blur_looks_for_mirrored_places_once_a_line(spark):
    """Each of the weights of each pixel made its own search for the mirrored place."""
    df = spark.createDataFrame([("m", 0, 0, 0, x, float(x)) for x in range(4)], "movie string, t int, z int, y int, x int, v double")
    blurred = motion.blur(df, "x", ["v"], 2.0, 21, edge=True)
    assert blurred._jdf.queryExecution().optimizedPlan().toString().count("pmod(") <= 2
    line, w = [0.0, 1.0, 2.0, 3.0, 3.0, 2.0, 1.0, 0.0], np.exp(-((np.arange(21) - 10) ** 2) / 8.0)
    for r in blurred.collect():
        assert r.v == pytest.approx(sum(w[o] * line[(r.x + o - 10) % 8] for o in range(21)) / w.sum())


def test_extreme_pairs_rank_as_all_pairs_do(spark):
    """Only pairs that may have a rank leave a block: 2 x 3 of each row, not all 29; ties, NaN and vectors without a product are as before."""
    rng = np.random.default_rng(4)
    rows = [(g, 100 * g + i, rng.integers(0, 3, 4).astype(float).tolist()) for g in range(2) for i in range(30)]
    rows += [(0, 90, [float("nan"), 0.0, 1.0, 2.0]), (0, 91, [1.0, None, 0.0, 0.0]), (1, 190, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "g int, p long, v array<double>")
    for part in (df, df.filter("p not in (90, 91, 190)")):
        few = vectors.block_extremes(part, ["g"], "p", "v", 3, 3, 2, keep=["g"])
        assert few.count() <= part.count() * 6
        ranked = lambda pairs: sorted(map(str, vectors.nearest_and_farthest(pairs, 3).collect()))
        assert ranked(few.drop("g")) == ranked(vectors.block_distances(part, ["g"], "p", "v", 2))
    assert vectors.block_extremes(df.filter("p < 0"), ["g"], "p", "v", 3, 3).count() == 0


def test_losses_sort_few_pairs(spark, monkeypatch):
    """The losses made and sorted all pairs of a patch; now they ask for no table of them."""
    monkeypatch.setattr(vectors, "block_distances", None)
    from voxtrail.plans import catalog

    assert len(catalog.QUERIES["contrastive_terms"](spark, "/root/testdata/sf0.001").collect()) == 1


def test_flow_blurs_its_parts_together(monkeypatch):
    """Each of a round's five parts was blurred by itself, and each frame fitted by itself, which cost small planes five times what they cost now."""
    from voxtrail.operators import flow

    rng = np.random.default_rng(6)
    a, b = rng.random((2, 12, 17))
    calls, blur = [], flow.gaussian
    monkeypatch.setattr(flow, "gaussian", lambda x, s: calls.append(x.shape) or blur(x, s))
    flow.farneback(a, b, levels=1, rounds=2)
    assert calls == [(12, 17, 5)] * 2
    for both, one in zip(flow.expand(np.stack((a, b), -1)), flow.expand(b)):
        np.testing.assert_allclose(both[..., 1], one, atol=1e-12)
    y, x = rng.random((2, 12, 17)) * 20 - 3
    np.testing.assert_allclose(flow._sample(np.stack((a, b), -1), y, x)[..., 1], flow._sample(b, y, x), atol=1e-12)
