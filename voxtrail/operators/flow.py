"""Dense optical flow by polynomial expansion (Farneback's method), in numpy.

Each frame is fitted by a quadratic polynomial around every pixel; the displacement that
makes two frames' polynomials agree is averaged over a window, refined in rounds and from
coarse to fine.  A pair of planes is the unit of work: `dense_flow` groups plane pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from voxtrail.operators.segmentation import gaussian

LEVELS, WINDOW, ROUNDS, POLY_N, POLY_SIGMA = 3, 15, 3, 5, 1.2


def _correlate(a: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    r = len(kernel) // 2
    p = np.pad(a, [(r, r) if i == axis else (0, 0) for i in range(a.ndim)], mode="edge")
    return np.lib.stride_tricks.sliding_window_view(p, len(kernel), axis) @ kernel


def expand(image: np.ndarray, n: int = POLY_N, sigma: float = POLY_SIGMA) -> tuple[np.ndarray, ...]:
    """Coefficients (bx, by, axx, ayy, axy) of the weighted quadratic fit around each pixel; further axes hold further images.

    The weights are even and separable, so the normal equations decouple: the linear and the mixed
    terms stand alone, and the constant with the two squares make a 3 x 3 system.
    """
    k = np.arange(-n, n + 1, dtype=float)
    g = np.exp(-(k**2) / (2 * sigma**2))
    g /= g.sum()
    m2, m4 = (g * k**2).sum(), (g * k**4).sum()
    kernels = np.stack([g * k**i for i in (0, 1, 2)], -1)
    both = _correlate(_correlate(image, kernels, 0), kernels, 1)
    at = {(i, j): both[..., i, j] for i, j in ((0, 0), (0, 1), (1, 0), (1, 1), (0, 2), (2, 0))}
    inverse = np.linalg.inv(np.array([[1, m2, m2], [m2, m4, m2 * m2], [m2, m2 * m2, m4]]))
    _, axx, ayy = (sum(inverse[r, c] * v for c, v in enumerate((at[0, 0], at[0, 2], at[2, 0]))) for r in range(3))
    return at[0, 1] / m2, at[1, 0] / m2, axx, ayy, at[1, 1] / (m2 * m2)


def _sample(a: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Bilinear values at places clipped to the plane, of each image that a third axis holds."""
    y, x = np.clip(y, 0, a.shape[0] - 1), np.clip(x, 0, a.shape[1] - 1)
    y0, x0 = np.minimum(y.astype(int), max(a.shape[0] - 2, 0)), np.minimum(x.astype(int), max(a.shape[1] - 2, 0))
    y1, x1, fy, fx = np.minimum(y0 + 1, a.shape[0] - 1), np.minimum(x0 + 1, a.shape[1] - 1), y - y0, x - x0
    if a.ndim > 2:
        fy, fx = fy[..., None], fx[..., None]
    return (a[y0, x0] * (1 - fx) + a[y0, x1] * fx) * (1 - fy) + (a[y1, x0] * (1 - fx) + a[y1, x1] * fx) * fy


def resize(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear resampling with pixel centres aligned."""
    y = (np.arange(height) + 0.5) * a.shape[0] / height - 0.5
    x = (np.arange(width) + 0.5) * a.shape[1] / width - 0.5
    return _sample(a, *np.meshgrid(y, x, indexing="ij"))


def farneback(first: np.ndarray, second: np.ndarray, levels: int = LEVELS, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(u, v): where each pixel of `first` went along x and y."""
    first, second = first.astype(float), second.astype(float)
    h, w = first.shape
    u = v = None
    for level in range(levels - 1, -1, -1):
        scale = 0.5**level
        size = (max(2 * POLY_N, round(h * scale)), max(2 * POLY_N, round(w * scale)))
        if level and min(h * scale, w * scale) < 2 * POLY_N:
            continue
        blur = (1 / scale - 1) * 0.5
        a, b = ((resize(gaussian(i, blur) if blur > 0 else i, *size) if level else i) for i in (first, second))
        if u is None:
            u, v = np.zeros(a.shape), np.zeros(a.shape)
        else:
            u, v = resize(u, *a.shape) * a.shape[1] / u.shape[1], resize(v, *a.shape) * a.shape[0] / v.shape[0]
        # What is done to several images is done to them at once: most planes are small.
        fits = expand(np.stack((a, b), -1))
        pa, pb = [c[..., 0] for c in fits], np.stack([c[..., 1] for c in fits], -1)
        yy, xx = np.mgrid[: a.shape[0], : a.shape[1]].astype(float)
        for _ in range(rounds):
            bx, by, axx, ayy, axy = np.moveaxis(_sample(pb, yy + v, xx + u), -1, 0)
            axx, ayy, axy = (axx + pa[2]) / 2, (ayy + pa[3]) / 2, (axy + pa[4]) / 4
            dx = (pa[0] - bx) / 2 + axx * u + axy * v
            dy = (pa[1] - by) / 2 + axy * u + ayy * v
            parts = (axx * axx + axy * axy, axy * (axx + ayy), ayy * ayy + axy * axy, axx * dx + axy * dy, axy * dx + ayy * dy)
            g11, g12, g22, h1, h2 = np.moveaxis(gaussian(np.stack(parts, -1), window * 0.15), -1, 0)
            det = g11 * g22 - g12 * g12 + 1e-9
            u, v = (g22 * h1 - g12 * h2) / det, (g11 * h2 - g12 * h1) / det
    return u, v


def dense_flow(frames: DataFrame, scales: list[int]) -> DataFrame:
    """Fields between the planes (movie, z, y, x, v) of frames t and t + scale; pairs of planes run side by side."""
    first = frames.select("movie", "z", F.col("t").alias("t0"), F.explode(F.array(*map(F.lit, scales))).alias("scale"), F.lit(0).alias("side"), "y", "x", "v")
    second = frames.select("movie", "z", "t", F.explode(F.array(*map(F.lit, scales))).alias("scale"), F.lit(1).alias("side"), "y", "x", "v")
    second = second.withColumn("t0", F.col("t") - F.col("scale")).drop("t")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        shape = (pdf.y.max() + 1, pdf.x.max() + 1)
        planes = np.zeros((2, *shape))
        planes[pdf.side, pdf.y, pdf.x] = pdf.v
        if pdf.side.nunique() < 2:
            return pd.DataFrame(columns=["movie", "t0", "t1", "scale", "z", "y", "x", "u", "v"])
        u, v = farneback(*planes)
        here = pdf[pdf.side == 0]
        out = here[["movie", "t0", "scale", "z", "y", "x"]].copy()
        out["t1"] = out.t0 + out.scale
        out["u"], out["v"] = u[here.y, here.x], v[here.y, here.x]
        return out[["movie", "t0", "t1", "scale", "z", "y", "x", "u", "v"]]

    pairs = first.unionByName(second)
    return pairs.groupBy("movie", "z", "t0", "scale").applyInPandas(one, "movie string, t0 int, t1 int, scale int, z int, y int, x int, u double, v double")
