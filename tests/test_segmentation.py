"""Plane kernels and slice stitching on hand-built arrays."""

import numpy as np
import pytest

from voxtrail.operators import segmentation as S, shapes


def flood(mask):
    """Brute-force 4-connected components in scan order."""
    out, n = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask)):
        if out[y, x]:
            continue
        n += 1
        todo = [(y, x)]
        while todo:
            a, b = todo.pop()
            if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not out[a, b]:
                out[a, b] = n
                todo += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
    return out


@pytest.mark.parametrize("seed", range(8))
def test_components_match_flood_fill(seed):
    mask = np.random.default_rng(seed).random((17, 13)) < 0.55
    assert np.array_equal(S.components(mask), flood(mask))


def test_two_squares_are_two_cells():
    prob = np.zeros((20, 20))
    prob[2:8, 2:8] = prob[11:17, 11:17] = 0.9
    emb = np.ones((20, 20, 2))
    out = S.segment_plane(prob, emb, S.Parameters(seed_size=30, blur_sigma=1.0))
    assert out.max() == 2 and (out == 1).sum() == 36 and (out == 2).sum() == 36 and out[3, 3] == 1


def test_embeddings_split_touching_cells():
    prob = np.zeros((16, 24))
    y, x = np.mgrid[:16, :24]
    slope = 0.9 - 0.02 * np.minimum(np.hypot(y - 8, x - 7), np.hypot(y - 8, x - 16))
    prob[4:12, 4:20] = slope[4:12, 4:20]
    emb = np.zeros((16, 24, 2))
    emb[:, :12, 0] = emb[:, 12:, 1] = 1.0
    out = S.segment_plane(prob, emb, S.Parameters(seed_size=5, affinity=0.7, blur_sigma=0.3, merge_affinity=0.65))
    assert len(np.unique(out[5, 4:20])) == 2


def test_holes_are_filled_and_fragments_merged():
    ring = np.zeros((9, 9), int)
    ring[2:7, 2:7] = 1
    ring[4, 4] = 0
    assert S.fill_holes(ring)[4, 4] == 1
    two = np.zeros((10, 10), int)
    two[2:8, 2:5], two[2:8, 5:8] = 1, 2
    emb, prob = np.ones((10, 10, 2)), np.full((10, 10), 0.9)
    assert S.merge(two, emb, prob, S.Parameters(min_size=1)).max() == 1
    assert S.merge(two, emb, prob * 0.1, S.Parameters(min_size=1)).max() == 2


def test_second_pass_fills_what_the_first_left():
    prob = np.zeros((30, 30))
    prob[3:12, 3:12], prob[20:25, 20:25] = 0.9, 0.9
    out = S.segment_two_pass(prob, np.ones((30, 30, 2)))
    assert out[5, 5] == 1 and out[22, 22] == 2


def stack(slices):
    """Sizes and overlaps of a [Z, H, W] label volume."""
    sizes = {z: {int(i): int((s == i).sum()) for i in np.unique(s) if i} for z, s in enumerate(slices)}
    over = {}
    for z in range(len(slices)):
        for k in (1, 2):
            if z + k < len(slices):
                pairs = {}
                for a, b in zip(slices[z].ravel(), slices[z + k].ravel()):
                    if a and b:
                        pairs[int(a), int(b)] = pairs.get((int(a), int(b)), 0) + 1
                over[z, z + k] = [(a, b, n) for (a, b), n in pairs.items()]
    return sizes, over


def plane(*boxes):
    out = np.zeros((6, 12), int)
    for label, y, x in boxes:
        out[y : y + 3, x : x + 3] = label
    return out


def test_one_object_in_two_slices_gets_one_label():
    assert len(set(S.stitch_slices(*stack([plane((5, 1, 1)), plane((9, 1, 1))])).values())) == 1


def test_gap_is_bridged_only_with_tolerance():
    vol = stack([plane((1, 1, 1)), plane(), plane((2, 1, 1))])
    assert S.stitch_slices(*vol, gap=1) == {(0, 1): 1, (2, 2): 1}
    assert S.stitch_slices(*vol, gap=0) == {(0, 1): 1, (2, 2): 2}


def test_slices_without_overlap_stay_as_they_are():
    vol = stack([plane((1, 1, 0)), plane((1, 1, 8))])
    assert S.stitch_slices(*vol, gap=0) == {(0, 1): 1, (1, 1): 1}
    assert S.stitch_slices(*vol, gap=0, relabel_disjoint=True) == {(0, 1): 1, (1, 1): 2}


def test_lowest_label_wins_over_greatest_overlap():
    up = np.zeros((6, 12), int)
    up[1:4, 1], up[1:4, 2:4] = 3, 2
    up2 = up.copy()
    up2[up == 3], up2[up == 2] = 2, 3
    found = S.stitch_slices(*stack([plane((1, 1, 1)), up2]), gap=0)
    assert found[1, 2] == 1 and found[1, 3] != 1


def test_stitching_from_voxel_rows(spark):
    vol = [plane((1, 1, 1), (2, 1, 8)), plane((4, 1, 1), (3, 1, 8))]
    rows = [("m", 0, z, int(y), int(x), int(s[y, x])) for z, s in enumerate(vol) for y, x in zip(*np.nonzero(s))]
    df = spark.createDataFrame(rows, "movie string, t int, z int, y int, x int, label int")
    got = {(r.z, r.label): r.new_label for r in S.stitch(df).collect()}
    assert got == {(0, 1): 1, (0, 2): 2, (1, 4): 1, (1, 3): 2}


def test_segment_groups_planes(spark):
    rows = [("m", 0, z, y, x, 0.9 if 2 <= y < 8 and 2 <= x < 8 else 0.0, [1.0, 0.0]) for z in (0, 1) for y in range(10) for x in range(10)]
    df = spark.createDataFrame(rows, "movie string, t int, z int, y int, x int, prob double, emb array<double>")
    out = S.segment(df).toPandas()
    assert out.groupby("z").size().tolist() == [36, 36] and set(out.label) == {1}


def test_square_features():
    f = shapes.features_of(np.ones((8, 8), bool))
    assert f["area"] == 64 and f["extent"] == 1 and f["solidity"] == 1 and f["euler_number"] == 1 and f["perimeter"] == 28
    assert f["eccentricity"] == pytest.approx(0, abs=1e-6) and f["aspect_ratio"] == 1
    ring = np.ones((8, 8), bool)
    ring[3:5, 3:5] = False
    g = shapes.features_of(ring)
    assert g["euler_number"] == 0 and g["filled_area"] == 64 and g["fill"] == 60 / 64


def test_disc_features_and_outline():
    y, x = np.mgrid[-20:21, -20:21]
    disc = y * y + x * x <= 18 * 18
    f = shapes.features_of(disc)
    assert f["perimeter_crofton"] == pytest.approx(2 * np.pi * 18, rel=0.05) and f["perimeter"] == pytest.approx(2 * np.pi * 18, rel=0.06)
    ring = shapes.rings(disc)[0]
    assert np.array_equal(ring[0], ring[-1]) and shapes.ring_area(ring) == pytest.approx(disc.sum(), rel=0.05)


def test_morphology_rows(spark):
    rows = [("m", 0, 0, y, x, 1) for y in range(6) for x in range(7)] + [("m", 0, 0, 20, 20, 2)]
    df = spark.createDataFrame(rows, "movie string, t int, z int, y int, x int, label int")
    out = {r.label: r for r in shapes.morphology(df).collect()}
    assert out[1].area == 42 and out[1].ring_area == pytest.approx(41.5) and out[2].ring is None and out[2].area == 1


def test_pattern_features_equal_the_kernels(spark):
    from voxtrail.operators import shapes

    rng, rows, want = np.random.default_rng(5), [], {}
    for label in range(1, 25):
        mask = rng.random((rng.integers(1, 9), rng.integers(1, 9))) < rng.choice([0.3, 0.6, 0.9, 1.0])
        if not mask.any():
            continue
        found = shapes.features_of(mask)
        want[label] = [found[c] for c in ("area", "euler_number", "perimeter", "perimeter_crofton")]
        rows += [("m", 0, int(z), int(y), int(x), label) for z in (0, 1) for y, x in np.argwhere(mask)]
    df = spark.createDataFrame(rows + [("m", 0, 0, 0, 0, 0)], "movie string, t int, z int, y int, x int, label int")
    got = {r.label: [r.area, r.euler_number, r.perimeter, r.perimeter_crofton] for r in shapes.pattern_features(df).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
