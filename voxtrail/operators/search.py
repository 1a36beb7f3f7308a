"""Black-box search of parameters by covariance matrix adaptation.

The driver holds a few numbers for each parameter; every generation's candidates are one table,
so that trials and movies are scored side by side.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from voxtrail.operators import labels, scoring, segmentation, tracking

#: Bounds of the searched parameters.
TRACKING_BOUNDS = {"max_cost": (0.2, 3.0), "process_noise": (0.1, 10.0), "obs_noise": (1.0, 30.0), "chi2_gate": (2.0, 20.0), "w_color": (0.0, 2.0)}
SEGMENTATION_BOUNDS = {"prob_threshold": (0.1, 0.7), "affinity": (0.1, 0.95), "prob_weight": (0.0, 0.6), "merge_affinity": (0.3, 0.95), "merge_brightness": (0.2, 0.9)}


class Cma:
    """Maximises a function of points in the unit cube; ask() gives a generation, tell() takes its scores."""

    def __init__(self, start: np.ndarray, sigma: float = 0.15, seed: int = 1, size: int | None = None) -> None:
        n = len(start)
        self.n, self.mean, self.sigma, self.rng = n, np.array(start, float), sigma, np.random.default_rng(seed)
        self.size = size or 4 + int(3 * np.log(n))
        w = np.log(self.size / 2 + 0.5) - np.log(np.arange(1, self.size // 2 + 1))
        self.w = w / w.sum()
        self.eff = 1 / (self.w**2).sum()
        self.cs = (self.eff + 2) / (n + self.eff + 5)
        self.ds = 1 + 2 * max(0.0, np.sqrt((self.eff - 1) / (n + 1)) - 1) + self.cs
        self.cc = (4 + self.eff / n) / (n + 4 + 2 * self.eff / n)
        self.c1 = 2 / ((n + 1.3) ** 2 + self.eff)
        self.cm = min(1 - self.c1, 2 * (self.eff - 2 + 1 / self.eff) / ((n + 2) ** 2 + self.eff))
        self.expected = np.sqrt(n) * (1 - 1 / (4 * n) + 1 / (21 * n * n))
        self.cov, self.ps, self.pc, self.generation = np.eye(n), np.zeros(n), np.zeros(n), 0

    def ask(self) -> np.ndarray:
        values, self.axes = np.linalg.eigh(self.cov)
        self.lengths = np.sqrt(np.maximum(values, 1e-20))
        self.steps = self.rng.standard_normal((self.size, self.n)) * self.lengths @ self.axes.T
        return np.clip(self.mean + self.sigma * self.steps, 0.0, 1.0)

    def tell(self, points: np.ndarray, scores: np.ndarray) -> None:
        best = np.argsort(-np.asarray(scores), kind="stable")[: len(self.w)]
        steps = (points[best] - self.mean) / self.sigma
        move = self.w @ steps
        self.mean = self.mean + self.sigma * move
        self.generation += 1
        white = self.axes @ ((self.axes.T @ move) / self.lengths)
        self.ps = (1 - self.cs) * self.ps + np.sqrt(self.cs * (2 - self.cs) * self.eff) * white
        size = np.linalg.norm(self.ps)
        steady = size / np.sqrt(1 - (1 - self.cs) ** (2 * self.generation)) < (1.4 + 2 / (self.n + 1)) * self.expected
        self.pc = (1 - self.cc) * self.pc + steady * np.sqrt(self.cc * (2 - self.cc) * self.eff) * move
        self.cov = (1 - self.c1 - self.cm) * self.cov + self.c1 * np.outer(self.pc, self.pc) + self.cm * (steps.T * self.w) @ steps
        self.sigma = float(np.clip(self.sigma * np.exp(self.cs / self.ds * (size / self.expected - 1)), 1e-8, 1.0))


def maximise(score: Callable[[list[dict[str, float]]], list[float]], bounds: dict[str, tuple[float, float]], max_evals: int = 100, sigma: float = 0.15, start: dict[str, float] | None = None, seed: int = 1) -> tuple[dict[str, float], list[tuple[dict[str, float], float]]]:
    """Best parameters and the history of all trials; `score` takes a generation at once."""
    names = list(bounds)
    low, high = (np.array([bounds[n][i] for n in names]) for i in (0, 1))
    at = np.array([start[n] for n in names]) if start else (low + high) / 2
    cma, history = Cma((at - low) / (high - low), sigma, seed), []
    while len(history) < max_evals:
        points = cma.ask()
        trials = [dict(zip(names, map(float, low + p * (high - low)))) for p in points]
        scores = score(trials)
        history += list(zip(trials, scores))
        cma.tell(points, np.array(scores))
    return max(history, key=lambda h: h[1])[0], history


def tracking_scores(detections: DataFrame, trials: list[dict[str, float]]) -> list[float]:
    """The tracking objective of each trial, over all movies, from one job."""
    spark: SparkSession = detections.sparkSession
    grid = spark.createDataFrame(list(enumerate(trials)), "trial_id int, params map<string, double>")
    found = tracking.grid_search(detections.select("movie", "t", "cell_id", "z_um", "y_um", "x_um"), grid)
    coloured = found.join(detections.select("movie", "t", "cell_id", "color_id"), ["movie", "t", "cell_id"]).withColumn("movie", F.concat_ws("/", "trial_id", "movie"))
    rep = scoring.report(coloured).select(F.substring_index("movie", "/", 1).cast("int").alias("trial_id"), scoring.objective(F.coalesce("color_switch_rate", F.lit(1.0)), F.coalesce("continuity_mean", F.lit(0.0))).alias("score"))
    by = {r[0]: r[1] for r in rep.groupBy("trial_id").agg(F.avg("score")).collect()}
    return [by.get(i, -1.0) for i in range(len(trials))]


#: What the settings of a search are called in the segmenter's parameters.
_SEGMENTER = {"prob_threshold": "prob_threshold", "affinity": "affinity", "prob_weight": "prob_weight", "merge_affinity": "merge_affinity", "merge_brightness": "merge_brightness", "merge_distance": "merge_distance"}


def segmentation_scores(planes: DataFrame, voxels: DataFrame, channels: list[str], trials: list[dict[str, float]], base: segmentation.Parameters = segmentation.Parameters(), min_size: int = 100, purity: float = 0.7, count_penalty: float = 0.0) -> list[float]:
    """Each trial's purity score, averaged over frames, from one job: `planes` as `segmentation.segment` takes them, `voxels` their channels.

    A trial without any cell scores 0.
    """
    settings = {i: base.with_values(**{_SEGMENTER[k]: v for k, v in t.items()}) for i, t in enumerate(trials)}
    listed = planes.withColumn("trial_id", F.explode(F.array(*[F.lit(i) for i in settings])))

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = segmentation.label_plane(pdf, lambda prob, emb: segmentation.segment_plane(prob, emb, settings[key[0]]))
        out.insert(0, "trial_id", key[0])
        return out

    found = listed.groupBy("trial_id", "movie", "t", "z").applyInPandas(one, "trial_id int, movie string, t int, z int, y int, x int, label int")
    every = voxels.drop("label").withColumn("trial_id", F.explode(F.array(*[F.lit(i) for i in settings])))
    at = ["trial_id", "movie", "t", "z", "y", "x"]
    cells = every.join(found, at, "left").withColumn("label", F.coalesce("label", F.lit(0))).withColumn("movie", F.concat_ws("/", "trial_id", "movie")).drop("trial_id")
    scores = labels.purity_score(labels.classify(cells, channels, min_size, purity), count_penalty)
    by = {int(r[0]): r[1] for r in scores.groupBy(F.substring_index("movie", "/", 1).alias("trial")).agg(F.avg("score")).collect()}
    return [by.get(i, 0.0) for i in settings]


def optimise_segmentation(planes: DataFrame, voxels: DataFrame, channels: list[str], max_evals: int = 150, fixed: dict[str, float] | None = None, seed: int = 1, **scoring_options) -> tuple[dict[str, float], list[tuple[dict[str, float], float]]]:
    """Searches the segmenter's five parameters but the fixed ones, a generation at a time."""
    fixed = fixed or {}
    bounds = {k: b for k, b in SEGMENTATION_BOUNDS.items() if k not in fixed}
    return maximise(lambda trials: segmentation_scores(planes, voxels, channels, [{**t, **fixed} for t in trials], **scoring_options), bounds, max_evals, seed=seed)


def optimise_tracking(detections: DataFrame, max_evals: int = 100, fixed: dict[str, float] | None = None, seed: int = 1) -> tuple[dict[str, float], list[tuple[dict[str, float], float]]]:
    """Searches the tracker's parameters but the fixed ones."""
    fixed = fixed or {}
    bounds = {k: b for k, b in TRACKING_BOUNDS.items() if k not in fixed}
    return maximise(lambda trials: tracking_scores(detections, [{**t, **fixed} for t in trials]), bounds, max_evals, seed=seed)
