"""Instance segmentation of planes from a probability map and pixel embeddings, and stitching of slices.

Planes are grids of a bounded size, so a plane is the unit of work: `segment` groups pixel rows
by (movie, t, z) and runs the numpy kernels on each.  Stitching over z needs overlap counts only,
which are made relationally (labels.slice_overlaps); the fold over slices sees small tables.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from voxtrail.operators import labels

_FOUR = ((-1, 0), (1, 0), (0, -1), (0, 1))


@dataclass(frozen=True)
class Parameters:
    """Settings of one pass; `affinity` is lowered by `prob_weight` times the pixel's probability."""

    prob_threshold: float = 0.3
    affinity: float = 0.5
    prob_weight: float = 0.3
    seed_size: int = 12
    blur_sigma: float = 1.5
    merge_affinity: float = 0.65
    merge_distance: float = 1.5
    merge_brightness: float = 0.6
    min_contact: int = 1
    max_iter: int = 200
    min_size: int = 20

    def with_values(self, **values) -> Parameters:
        return replace(self, **values)


LARGE = Parameters(seed_size=24, affinity=0.7, max_iter=100)
SMALL = Parameters(seed_size=10, affinity=0.4, merge_affinity=0.6, max_iter=100)


def shifted(a: np.ndarray, dy: int, dx: int, fill) -> np.ndarray:
    """The array whose [y, x] is a[y + dy, x + dx], `fill` outside."""
    out = np.full_like(a, fill)
    h, w = a.shape[:2]
    ys, xs = slice(max(0, -dy), min(h, h - dy)), slice(max(0, -dx), min(w, w - dx))
    yt, xt = slice(max(0, dy), min(h, h + dy)), slice(max(0, dx), min(w, w + dx))
    out[ys, xs] = a[yt, xt]
    return out


def components(mask: np.ndarray) -> np.ndarray:
    """4-connected components, numbered in scan order: pixels point to a smaller neighbour until all point to a root."""
    h, w = mask.shape
    up = np.arange(h * w)
    at = np.flatnonzero(mask.ravel())
    pairs = [np.stack((a := np.flatnonzero((mask & shifted(mask, dy, dx, False)).ravel()), a + dy * w + dx)) for dy, dx in ((0, 1), (1, 0))]
    a, b = np.concatenate(pairs, 1) if pairs else (at, at)
    while len(a):
        ra, rb = up[a], up[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        np.minimum.at(up, high, low)
        while True:
            nxt = up[up]
            if np.array_equal(nxt, up):
                break
            up = nxt
        open_ = up[a] != up[b]
        a, b = a[open_], b[open_]
    out = np.zeros(h * w, np.int64)
    if len(at):
        out[at] = np.unique(up[at], return_inverse=True)[1] + 1
    return out.reshape(h, w)


def window_max(a: np.ndarray, size: int) -> np.ndarray:
    """Greatest value in a square window of the first two axes; an even size reaches one further back, and edges are reflected."""
    for axis in (0, 1):
        p = np.pad(a, [(size // 2, size - 1 - size // 2) if i == axis else (0, 0) for i in range(a.ndim)], mode="symmetric")
        a = np.lib.stride_tricks.sliding_window_view(p, size, axis).max(-1)
    return a


def gaussian(a: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian blur of the first two axes, cut at four sigma, edges reflected."""
    r = int(4 * sigma + 0.5)
    if r == 0:
        return a
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        p = np.pad(a, [(r, r) if i == axis else (0, 0) for i in range(a.ndim)], mode="symmetric")
        a = np.tensordot(np.lib.stride_tricks.sliding_window_view(p, 2 * r + 1, axis), k, 1)
    return a


def seeds(prob: np.ndarray, mask: np.ndarray, size: int) -> np.ndarray:
    """Numbered seeds: peaks of windows, and the highest pixel of each component that has none."""
    peaks = (window_max(prob, size) == prob) & mask
    parts = components(mask)
    have = np.zeros(parts.max() + 1, bool)
    have[parts[peaks]] = True
    order = np.lexsort((np.arange(prob.size), -prob.ravel(), parts.ravel()))
    which, first = np.unique(parts.ravel()[order], return_index=True)
    lacking = (which > 0) & ~have[which]
    peaks.ravel()[order[first[lacking]]] = True
    return components(peaks)


def grow(emb: np.ndarray, start: np.ndarray, mask: np.ndarray, prob: np.ndarray, p: Parameters) -> np.ndarray:
    """Grows all seeds together: in each round a border pixel joins the neighbour of greatest affinity, if it is enough."""
    out = start.copy()
    need = p.affinity - prob * p.prob_weight
    # Affinities of neighbours do not change, so they are taken once for all rounds.
    near = [(emb * shifted(emb, dy, dx, 0.0)).sum(-1) for dy, dx in _FOUR]
    for _ in range(p.max_iter):
        free = (out == 0) & mask
        best, label = np.full(out.shape, -1.0), np.zeros_like(out)
        for (dy, dx), affinity in zip(_FOUR, near):
            neighbour = shifted(out, dy, dx, 0)
            better = free & (neighbour > 0) & (affinity > best)
            best[better], label[better] = affinity[better], neighbour[better]
        joins = (label > 0) & (best > need)
        if not joins.any():
            break
        out[joins] = label[joins]
    return renumber(out, p.min_size)


def renumber(instances: np.ndarray, min_size: int) -> np.ndarray:
    """Drops labels of fewer pixels and numbers the others 1, 2 and so on."""
    n = np.bincount(instances.ravel())
    kept = np.flatnonzero(n >= min_size)
    kept = kept[kept > 0]
    table = np.zeros(len(n), np.int64)
    table[kept] = np.arange(1, len(kept) + 1)
    return table[instances]


def fill_holes(instances: np.ndarray) -> np.ndarray:
    """Gives each label what it encloses, in ascending order; later labels overwrite earlier ones."""
    out = instances.copy()
    for i in np.unique(instances)[1:] if (instances == 0).any() else np.unique(instances):
        ys, xs = np.nonzero(instances == i)
        box = np.pad(instances[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1] == i, 1)
        outside = components(~box)
        inside = (outside != outside[0, 0])[1:-1, 1:-1]
        view = out[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1]
        view[inside] = i
    return out


def _reach(mask: np.ndarray, radius: float) -> np.ndarray:
    """Pixels within `radius` of the mask."""
    r, out = int(radius), np.zeros_like(mask)
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            if dy * dy + dx * dx <= radius * radius:
                out |= shifted(mask, dy, dx, False)
    return out


def merge(instances: np.ndarray, emb: np.ndarray, prob: np.ndarray, p: Parameters) -> np.ndarray:
    """Merges neighbouring fragments with enough contact that is bright and embeddings that agree, in ascending order."""
    ids = [int(i) for i in np.unique(instances) if i]
    means = {i: (m := emb[instances == i].mean(0)) / (np.linalg.norm(m) + 1e-5) for i in ids}
    into: dict[int, int] = {}
    for i in ids:
        mask = instances == i
        near, touch = _reach(mask, p.merge_distance), _reach(mask, 1.0)
        for j in (int(k) for k in np.unique(instances[near & ~mask]) if k):
            if j in into:
                continue
            other = instances == j
            contact = touch & other
            gap = near & _reach(other, p.merge_distance) & ~mask & ~other
            bright = prob[contact].mean() if contact.any() else prob[gap].mean() if gap.any() else 0.5
            if contact.sum() < p.min_contact or np.clip(bright, 0, 1) < p.merge_brightness or means[i] @ means[j] < p.merge_affinity:
                continue
            into[max(i, j)] = min(i, j)
    root = np.arange(instances.max() + 1)
    for k in sorted(into):
        r = k
        while r in into:
            r = into[r]
        root[k] = r
    return renumber(root[instances], p.min_size)


def segment_plane(prob: np.ndarray, emb: np.ndarray, p: Parameters = Parameters()) -> np.ndarray:
    """Labels of one plane."""
    mask = prob > p.prob_threshold
    if not mask.any():
        return np.zeros(prob.shape, np.int64)
    emb = gaussian(emb / (np.linalg.norm(emb, axis=2, keepdims=True) + 1e-5), p.blur_sigma)
    out = fill_holes(grow(emb, seeds(prob, mask, p.seed_size), mask, prob, p))
    return merge(out, emb, prob, p) if p.merge_distance > 0 else out


def segment_two_pass(prob: np.ndarray, emb: np.ndarray, large: Parameters = LARGE, small: Parameters = SMALL) -> np.ndarray:
    """A pass for large objects, then one for small objects where the first left bright pixels; ids of the second follow."""
    first = segment_plane(prob, emb, large)
    rest = np.where(first > 0, 0.0, prob)
    second = segment_plane(rest, emb, small)
    add = (first == 0) & (second > 0) & (prob > large.prob_threshold)
    return np.where(add, second + first.max(), first)


def label_plane(pdf: pd.DataFrame, segmenter) -> pd.DataFrame:
    """The labelled pixels of one plane's rows."""
    y, x = pdf.y.to_numpy(), pdf.x.to_numpy()
    emb = np.stack(pdf.emb.to_numpy())
    prob, grid = np.zeros((y.max() + 1, x.max() + 1)), np.zeros((y.max() + 1, x.max() + 1, emb.shape[1]))
    prob[y, x], grid[y, x] = pdf.prob.to_numpy(), emb
    out = pdf[["movie", "t", "z", "y", "x"]].assign(label=segmenter(prob, grid)[y, x].astype("int32"))
    return out[out.label > 0]


def segment(pixels: DataFrame, p: Parameters = Parameters(), two_pass: bool = False) -> DataFrame:
    """Labels of all pixels (movie, t, z, y, x, prob, emb); planes run side by side."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return label_plane(pdf, segment_two_pass if two_pass else lambda prob, emb: segment_plane(prob, emb, p))

    return pixels.groupBy("movie", "t", "z").applyInPandas(one, "movie string, t int, z int, y int, x int, label int")


def stitch_slices(sizes: dict[int, dict[int, int]], overlap: dict[tuple[int, int], list[tuple[int, int, int]]], threshold: float = 0.0, gap: int = 1, gap_threshold: float = 0.3, relabel_disjoint: bool = False) -> dict[tuple[int, int], int]:
    """New label of each (slice, label), from sizes by slice and overlaps (a, b, n) by (slice, next slice).

    A label maps to the lowest label above it with a Jaccard index over `threshold`; that takes the
    lowest label that maps to it.  Others get new numbers in the order of their labels.  A pair of slices
    without any overlap is left as it is, unless `relabel_disjoint`.  Then labels that end are carried
    over gaps of up to `gap` slices to the label of greatest index, if it is over `gap_threshold`.
    """
    zs = range(min(sizes), max(sizes) + 1) if sizes else range(0)
    least = min([min(s) - 1 for s in sizes.values() if s] + ([0] if any(not sizes.get(z) for z in zs) else []), default=0)
    name = {(z, a): a - least for z in zs for a in sizes.get(z, {})}
    top = max(name.values(), default=0)
    for z in zs[:-1]:
        pairs = overlap.get((z, z + 1), [])
        above = sizes.get(z + 1, {})
        if not pairs and not (relabel_disjoint and above):
            continue
        lowest: dict[int, int] = {}
        for a, b, n in pairs:
            if n / (sizes[z][a] + above[b] - n) > threshold:
                lowest[a] = min(lowest.get(a, b), b)
        taken: dict[int, int] = {}
        for a, b in lowest.items():
            taken[b] = min(taken.get(b, name[z, a]), name[z, a])
        fresh = top
        for number in range(1, max(above, default=0) - least + 1):  # unused numbers take up a new one too
            b = number + least
            if b in taken:
                name[z + 1, b] = taken[b]
            else:
                fresh += 1
                if b in above:
                    name[z + 1, b] = fresh
        top = fresh
    last: dict[int, int] = {}
    for (z, _), label in name.items():
        last[label] = max(last.get(label, z), z)
    for z in zs[:-1]:
        ending = sorted(label for label, at in last.items() if at == z)
        for skip in range(1, gap + 1):
            to = z + skip + 1
            if not ending or to > zs[-1]:
                break
            here, there = ({c: sum(n for a, n in sizes.get(k, {}).items() if name[k, a] == c) for c in {name[k, a] for a in sizes.get(k, {})}} for k in (z, to))
            share: dict[int, dict[int, int]] = {}
            for a, b, n in overlap.get((z, to), []):
                row = share.setdefault(name[z, a], {})
                row[name[to, b]] = row.get(name[to, b], 0) + n
            claimed, bridged = set(), set()
            for label in ending:
                scores = {b: n / (here[label] + there[b] - n) for b, n in share.get(label, {}).items()}
                best = min(scores, key=lambda b: (-scores[b], b), default=None)
                if best is None or scores[best] <= gap_threshold or best in claimed:
                    continue
                claimed.add(best)
                bridged.add(label)
                for key, now in name.items():
                    if key[0] >= to and now == best:
                        name[key] = label
            ending = [label for label in ending if label not in bridged]
    return {key: label + least for key, label in name.items()}


def stitch(voxels: DataFrame, threshold: float = 0.0, gap: int = 1, gap_threshold: float = 0.3, relabel_disjoint: bool = False) -> DataFrame:
    """movie, t, z, label and new_label of every label of every slice."""
    v = labels.foreground(voxels)
    sizes = v.groupBy("movie", "t", "z", "label").agg(F.count(F.lit(1)).alias("n")).select("movie", "t", "z", F.lit(0).alias("skip"), "label", F.lit(0).alias("up"), "n")
    for k in range(1, gap + 2):
        o = labels.slice_overlaps(v, k).select("movie", "t", "z", F.lit(k).alias("skip"), "label", F.col("label_up").alias("up"), "n")
        sizes = sizes.unionByName(o)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        by: dict[int, dict[int, int]] = {}
        over: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for z, skip, a, b, n in pdf[["z", "skip", "label", "up", "n"]].itertuples(index=False):
            if skip == 0:
                by.setdefault(z, {})[a] = n
            else:
                over.setdefault((z, z + skip), []).append((a, b, n))
        found = stitch_slices(by, over, threshold, gap, gap_threshold, relabel_disjoint)
        return pd.DataFrame([(pdf.movie.iloc[0], pdf.t.iloc[0], z, a, new) for (z, a), new in sorted(found.items())], columns=["movie", "t", "z", "label", "new_label"])

    return sizes.groupBy("movie", "t").applyInPandas(one, "movie string, t int, z int, label int, new_label int")


def crops(pixels: DataFrame, centres: DataFrame, half: int = 12, depth: int = 1) -> DataFrame:
    """z-scored greatest values over a few slices in a square around each centre (movie, t, cell_id, z, y, x)."""
    reach = F.transform(F.sequence(F.lit(-depth), F.lit(depth)), lambda d: F.col("z") + d)
    side = lambda c: F.sequence(F.col(c) - half, F.col(c) + half - 1)
    listed = centres.select("movie", "t", "cell_id", F.col("y").alias("cy"), F.col("x").alias("cx"), F.explode(reach).alias("z"), "y", "x")
    listed = listed.withColumn("y", F.explode(side("cy"))).withColumn("x", F.explode(side("cx")))
    # Listed places are many more than Spark expects of their centres; a merge keeps them out of the driver.
    got = listed.hint("merge").join(pixels, ["movie", "t", "z", "y", "x"]).groupBy("movie", "t", "cell_id", (F.col("y") - F.col("cy")).alias("dy"), (F.col("x") - F.col("cx")).alias("dx")).agg(F.max("v").alias("v"))
    stats = got.groupBy("movie", "t", "cell_id").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    return got.join(stats, ["movie", "t", "cell_id"]).select("movie", "t", "cell_id", "dy", "dx", ((F.col("v") - F.col("m")) / (F.col("s") + 1e-5)).alias("v"))
