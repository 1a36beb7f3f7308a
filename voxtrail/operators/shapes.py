"""Outlines and shape features of cells' projections along z.

Cells are small, so a cell is the unit of work of `outlines` and `features`; what sums can
express is in labels.shape_moments.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from voxtrail.operators import labels
from voxtrail.operators.segmentation import components, shifted

FEATURES = ("area", "bbox_area", "convex_area", "eccentricity", "equivalent_diameter", "euler_number", "extent", "filled_area", "major_axis", "minor_axis", "orientation", "perimeter", "perimeter_crofton", "solidity", "oblate", "prolate", "aspect_ratio", "perimeter2_area", "fill")

# For each pattern of a 2 x 2 neighbourhood, as corners above-left, above-right, below-left and
# below-right of a square, the sides of the half-level contour through it, by their middles (y, x).
_N, _S, _W, _E = (0.0, 0.5), (1.0, 0.5), (0.5, 0.0), (0.5, 1.0)
_SIDES = {1: [(_W, _N)], 2: [(_N, _E)], 3: [(_W, _E)], 4: [(_S, _W)], 5: [(_S, _N)], 6: [(_N, _E), (_S, _W)], 7: [(_S, _E)], 8: [(_E, _S)], 9: [(_W, _N), (_E, _S)], 10: [(_N, _S)], 11: [(_W, _S)], 12: [(_E, _W)], 13: [(_E, _N)], 14: [(_N, _W)]}

# The neighbourhood sums whose pixel is on a straight, a diagonal or a bent piece of the border's line.
_LINE = {**dict.fromkeys((5, 7, 15, 17, 25, 27), 1.0), **dict.fromkeys((21, 33), 2**0.5), **dict.fromkeys((13, 23), (1 + 2**0.5) / 2)}


def rings(mask: np.ndarray) -> list[np.ndarray]:
    """Closed outlines (y, x) of a mask at half level, by marching squares; the longest first."""
    p = np.pad(mask, 1).astype(int)
    code = p[:-1, :-1] + 2 * p[:-1, 1:] + 4 * p[1:, :-1] + 8 * p[1:, 1:]
    after: dict[tuple[float, float], list[tuple[float, float]]] = {}
    for y, x in zip(*np.nonzero((code > 0) & (code < 15))):
        for a, b in _SIDES[int(code[y, x])]:
            after.setdefault((y - 1 + a[0], x - 1 + a[1]), []).append((y - 1 + b[0], x - 1 + b[1]))
    out = []
    while after:
        start = min(after)
        ring = [start]
        while (nexts := after.get(ring[-1])) is not None:
            ring.append(nexts.pop())
            if not nexts:
                del after[ring[-2]]
            if ring[-1] == start:
                break
        out.append(np.array(ring))
    return sorted(out, key=len, reverse=True)


def ring_area(ring: np.ndarray) -> float:
    y, x = ring[:, 0], ring[:, 1]
    return float(abs((x[:-1] * y[1:] - x[1:] * y[:-1]).sum()) / 2)


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise, by monotone chains."""
    points = sorted(set(map(tuple, points.tolist())))
    if len(points) < 3:
        return np.array(points)

    def chain(some) -> list:
        out: list = []
        for p in some:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(points) + chain(points[::-1]))


def convex_area(mask: np.ndarray) -> int:
    """Pixels whose centre is in the hull of the mask's pixel corners."""
    ys, xs = np.nonzero(mask)
    corners = np.concatenate([np.stack((ys + dy, xs + dx), 1) for dy, dx in ((-0.5, 0), (0.5, 0), (0, -0.5), (0, 0.5))])
    ring = hull(corners)
    yy, xx = np.mgrid[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1]
    inside = np.ones(yy.shape, bool)
    for (ay, ax), (by, bx) in zip(ring, np.roll(ring, -1, 0)):
        inside &= (by - ay) * (xx - ax) - (bx - ax) * (yy - ay) >= -1e-9
    return int(inside.sum())


def perimeter(mask: np.ndarray) -> float:
    """Length of the line through the centres of border pixels: 1 for a straight step, the root of 2 for a diagonal one, their mean for a knight's."""
    p = np.pad(mask, 1)
    inner = p.copy()
    for dy, dx in ((-1, 0), (1, 0), (0, -1), (0, 1)):
        inner &= shifted(p, dy, dx, False)
    border = p & ~inner
    straight = sum(shifted(border, dy, dx, False).astype(int) for dy, dx in ((-1, 0), (1, 0), (0, -1), (0, 1)))
    diagonal = sum(shifted(border, dy, dx, False).astype(int) for dy, dx in ((-1, -1), (-1, 1), (1, -1), (1, 1)))
    code = (1 + 2 * straight + 10 * diagonal)[border]
    return float(sum(_LINE.get(int(c), 0.0) for c in code))


def crofton(mask: np.ndarray) -> float:
    """Perimeter from crossings of lines in four directions."""
    p = np.pad(mask, 1)
    cross = [int((p != shifted(p, dy, dx, False)).sum()) for dy, dx in ((0, 1), (1, 0), (1, 1), (1, -1))]
    return float(np.pi / 8 * (cross[0] + cross[1] + (cross[2] + cross[3]) / 2**0.5))


def features_of(mask: np.ndarray) -> dict[str, float]:
    """All FEATURES of one projected cell."""
    ys, xs = np.nonzero(mask)
    box = mask[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1]
    area = float(box.sum())
    outside = components(~np.pad(box, 1))
    filled = float((outside != outside[0, 0]).sum())
    myy, mxx, mxy = ys.var() + 1 / 12, xs.var() + 1 / 12, float(np.mean((ys - ys.mean()) * (xs - xs.mean())))
    root = np.hypot(mxx - myy, 2 * mxy)
    l1, l2 = (mxx + myy + root) / 2, max((mxx + myy - root) / 2, 0.0)
    major, minor = 4 * l1**0.5, 4 * l2**0.5
    around, convex = perimeter(box), float(convex_area(box))
    holes = len(np.unique(outside[outside > 0])) - 1
    parts = components_eight(box)
    return dict(
        zip(
            FEATURES,
            (
                area,
                float(box.size),
                convex,
                max(0.0, 1 - l2 / l1) ** 0.5,
                (4 * area / np.pi) ** 0.5,
                float(parts - holes),
                area / box.size,
                filled,
                major,
                minor,
                0.5 * float(np.arctan2(2 * mxy, myy - mxx)),
                around,
                crofton(box),
                area / convex,
                minor / major,
                major / max(minor, 1e-9),
                box.shape[1] / box.shape[0],
                around**2 / area,
                area / filled,
            ),
        )
    )


def components_eight(mask: np.ndarray) -> int:
    """How many 8-connected parts: 4-connected ones, joined at corners."""
    parts = components(mask)
    up = list(range(parts.max() + 1))

    def find(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    for dx in (-1, 1):
        other = shifted(parts, 1, dx, 0)
        for a, b in set(zip(parts[(parts > 0) & (other > 0)].tolist(), other[(parts > 0) & (other > 0)].tolist())):
            up[max(find(a), find(b))] = min(find(a), find(b))
    return len({find(i) for i in range(1, len(up))})


def _projected(voxels: DataFrame) -> DataFrame:
    return labels.foreground(voxels).select("movie", "t", "label", "y", "x").distinct()


def _mask(pdf: pd.DataFrame) -> tuple[np.ndarray, int, int]:
    y0, x0 = int(pdf.y.min()), int(pdf.x.min())
    mask = np.zeros((pdf.y.max() - y0 + 1, pdf.x.max() - x0 + 1), bool)
    mask[pdf.y - y0, pdf.x - x0] = True
    return mask, y0, x0


def features(voxels: DataFrame) -> DataFrame:
    """One row of FEATURES for each cell of each frame."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        found = features_of(_mask(pdf)[0])
        return pd.DataFrame([{"movie": pdf.movie.iloc[0], "t": pdf.t.iloc[0], "label": pdf.label.iloc[0], **found}])

    return _projected(voxels).groupBy("movie", "t", "label").applyInPandas(one, "movie string, t int, label int, " + ", ".join(f"{f} double" for f in FEATURES))


def pattern_features(voxels: DataFrame) -> DataFrame:
    """area, euler_number, perimeter and perimeter_crofton of each cell of each frame, from counts of neighbourhood patterns.

    A pixel is listed under the squares of 2 x 2 and the neighbourhoods that it lies in, and what each of these holds is
    summed up, so cells of any size spread over tasks and nothing leaves the JVM.
    """
    cell, at = ["movie", "t", "label"], ["movie", "t", "label", "y", "x"]
    pixels = _projected(voxels)

    def listed(rows: DataFrame, places: list[tuple[int, int, dict[str, int]]]) -> DataFrame:
        """Sums, over each pixel's surroundings, of what its rows put there: offsets and numbers by name."""
        spots = F.explode(F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"), *[F.lit(n).alias(c) for c, n in put.items()]) for dy, dx, put in places]))
        names = list(places[0][2])
        return rows.select(*cell, spots.alias("s")).groupBy(*cell, F.col("s.y").alias("y"), F.col("s.x").alias("x")).agg(*[F.sum(f"s.{c}").alias(c) for c in names])

    quads = listed(pixels, [(0, 0, {"code": 8}), (0, 1, {"code": 4}), (1, 0, {"code": 2}), (1, 1, {"code": 1})])
    bit = lambda i: F.col("code").bitwiseAND(1 << i) > 0  # noqa: E731  above-left, above-right, below-left, below-right
    differ = lambda i, j: F.sum((bit(i) != bit(j)).cast("long"))
    ones = F.bit_count("code")
    euler = F.sum(F.when(F.col("code").isin(6, 9), -2).when(ones == 1, 1).when(ones == 3, -1).otherwise(0)) / 4
    cross = F.lit(float(np.pi / 8)) * (differ(0, 1) + differ(0, 2) + (differ(0, 3) + differ(1, 2)) / F.lit(2**0.5))
    sums = quads.groupBy(*cell).agg((F.sum((bit(3)).cast("long"))).alias("area"), euler.alias("euler_number"), cross.alias("perimeter_crofton"))

    four, corners = ((-1, 0), (1, 0), (0, -1), (0, 1)), ((-1, -1), (-1, 1), (1, -1), (1, 1))
    around = listed(pixels, [(0, 0, {"own": 1, "near": 0}), *((dy, dx, {"own": 0, "near": 1}) for dy, dx in four)])
    border = around.filter("own = 1 and near < 4").select(*at)
    line = listed(border, [(0, 0, {"own": 1, "code": 1}), *((dy, dx, {"own": 0, "code": 2}) for dy, dx in four), *((dy, dx, {"own": 0, "code": 10}) for dy, dx in corners)])
    weight = F.lit(0.0)
    for code, length in _LINE.items():
        weight = F.when(F.col("code") == code, length).otherwise(weight)
    return sums.join(line.filter("own = 1").groupBy(*cell).agg(F.sum(weight).alias("perimeter")), cell)


def outlines(voxels: DataFrame, min_area: float = 10, min_points: int = 8) -> DataFrame:
    """The largest outline of each cell that has more than `min_points` points and the area."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        mask, y0, x0 = _mask(pdf)
        good = [r for r in rings(mask) if len(r) > min_points and ring_area(r) >= min_area]
        best = max(good, key=ring_area, default=None)
        rows = [] if best is None else [(pdf.movie.iloc[0], pdf.t.iloc[0], pdf.label.iloc[0], ring_area(best), [{"y": float(y + y0), "x": float(x + x0)} for y, x in best])]
        return pd.DataFrame(rows, columns=["movie", "t", "label", "ring_area", "ring"])

    return _projected(voxels).groupBy("movie", "t", "label").applyInPandas(one, "movie string, t int, label int, ring_area double, ring array<struct<y: double, x: double>>")


def morphology(voxels: DataFrame) -> DataFrame:
    """Features and outlines of all cells that have either; area 0 where only an outline was found."""
    out = features(voxels).join(outlines(voxels), ["movie", "t", "label"], "full_outer")
    return out.select("movie", "t", "label", *[F.coalesce(f, F.lit(0.0)).alias(f) for f in FEATURES], F.coalesce("ring_area", F.lit(0.0)).alias("ring_area"), "ring")
