"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest.

Rules and features are DataFrame functions; a fitted model is a sum of CASE
expressions, so judging a table is one projection without exchange or Python.
The trees are fitted on the driver from a sample of labelled URLs of at most
about `max_rows` distinct ones (default FIT_ROWS), chosen by a hash of the URL and
weighed by how many rows have them, so a URL in very many rows is one row of the sample.

Statistics of suffixes (a host's last label) are smoothed log odds of their labels.  A row that trees
learn from gets those of the other folds of hosts, so they do not tell it its own label.

Defined cases: a null url, or one without `://`, has empty host and path, fits
no rule and is judged by the trees (a null as an empty text); equal urls get
equal verdicts; without labelled urls, the trees allow everything;
among equal splits the first feature's lowest cut is taken; an empty table stays empty; a url of any length is read
whole; further columns are left out, and their names do not matter.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

FIT_ROWS = 20_000
FOLDS = 5
FEATURES = ("length", "host_length", "path_length", "depth", "host_dots", "hyphens", "digit_ratio", "entropy", "parameters", "suffix_odds")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules that the query op6 applies.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), ascii_uppercase, ascii_lowercase), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: tuple[Rule, ...], give: str) -> Column:
    """`give` ("text" or "verdict") of the longest rule that fits, else null."""
    chosen = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        chosen = F.when(fits, F.lit(getattr(rule, give))).otherwise(chosen)
    return chosen


def _count(text: Column, piece: str) -> Column:
    return F.length(text) - F.length(F.translate(text, piece, ""))


def _entropy(text: Column) -> Column:
    n = F.length(text).cast("double")
    share = F.transform(F.array_distinct(F.split(text, "")), lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.when(n > 0, -F.aggregate(share, F.lit(0.0), lambda a, p: a + F.when(p > 0, p * F.log2(p)).otherwise(0.0))).otherwise(0.0)


def add_features(df: DataFrame) -> DataFrame:
    """Adds host, path, the suffix and the features that need no statistics; reads column `url`."""
    host, path = host_and_path(F.col("url"))
    df = df.withColumn("__url", F.coalesce("url", F.lit(""))).withColumn("host", host).withColumn("path", path)
    u, h = F.col("__url"), F.col("host")
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    return df.select(
        "*",
        F.substring_index(h, ".", -1).alias("suffix"),
        F.length(u).cast("double").alias("length"),
        F.length(h).cast("double").alias("host_length"),
        F.length("path").cast("double").alias("path_length"),
        _count(F.col("path"), "/").cast("double").alias("depth"),
        _count(h, ".").cast("double").alias("host_dots"),
        _count(u, "-").cast("double").alias("hyphens"),
        (_count(u, "0123456789") / F.greatest(F.length(u), F.lit(1))).alias("digit_ratio"),
        _entropy(u).alias("entropy"),
        F.when(query == "", 0.0).otherwise((_count(query, "&") + 1).cast("double")).alias("parameters"),
    )


@dataclass
class Model:
    """Log odds of `block`: a start value and trees of (feature, cut, left, right) nodes or leaf values."""

    base: float
    trees: list
    suffix: dict[str, float]

    def score(self) -> Column:
        columns = {f: F.col(f) for f in FEATURES[:-1]}
        odds = F.from_json(F.lit(json.dumps(self.suffix)), "map<string,double>")
        columns["suffix_odds"] = F.coalesce(F.element_at(odds, F.col("suffix")), F.lit(0.0))

        def walk(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            return F.when(columns[FEATURES[node[0]]] <= node[1], walk(node[2])).otherwise(walk(node[3]))

        return sum((walk(t) for t in self.trees), F.lit(self.base))


def _odds(keys: list[str], y: np.ndarray, weight: np.ndarray) -> dict[str, float]:
    """Smoothed log odds of the keys."""
    found: dict[str, list[float]] = {}
    for key, label, w in zip(keys, y.tolist(), weight.tolist(), strict=True):
        found.setdefault(key, [0.0, 0.0])[int(label)] += w
    return {k: float(np.log((b + 1) / (a + 1))) for k, (a, b) in found.items()}


def other_odds(suffixes: list[str], hosts: list[str], y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The odds of each row's suffix among the rows of other folds of hosts; 0 where these have none."""
    fold = np.array([zlib.crc32(h.encode()) % FOLDS for h in hosts], np.int64)
    out = np.zeros(len(y))
    for f in range(FOLDS):
        rest = np.flatnonzero(fold != f)
        odds = _odds([suffixes[i] for i in rest], y[rest], weight[rest])
        for i in np.flatnonzero(fold == f):
            out[i] = odds.get(suffixes[i], 0.0)
    return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, penalty: float = 1.0) -> tuple[float, list]:
    """Gradient-boosted trees for weighed labels 0 and 1, split on quantile bins by the second-order gain."""
    base = float(np.log((weight @ y + 1) / (weight @ (1 - y) + 1)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    at = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    score, out = np.full(len(y), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (p - y), weight * p * (1 - p)
        step = np.zeros(len(y))

        def grow(rows: np.ndarray, left: int):
            gs, hs = g[rows].sum(), h[rows].sum()
            best, where = 1e-6, None
            if left and len(rows) > 1:
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    gl = np.cumsum(np.bincount(at[rows, j], g[rows], len(c) + 1))[:-1]
                    hl = np.cumsum(np.bincount(at[rows, j], h[rows], len(c) + 1))[:-1]
                    gain = gl**2 / (hl + penalty) + (gs - gl) ** 2 / (hs - hl + penalty) - gs**2 / (hs + penalty)
                    k = int(np.argmax(gain))
                    if gain[k] > best:
                        best, where = gain[k], (j, k)
            if where is None:
                leaf = float(-rate * gs / (hs + penalty))
                step[rows] = leaf
                return leaf
            j, k = where
            low = at[rows, j] <= k
            return j, float(cuts[j][k]), grow(rows[low], left - 1), grow(rows[~low], left - 1)

        out.append(grow(np.arange(len(y)), depth))
        score = score + step
    return base, out


def fit(labelled: DataFrame, max_rows: int = FIT_ROWS) -> Model:
    """Fits from columns url and block (1 or 0) of `labelled`, on a bounded sample of distinct urls."""
    distinct = labelled.agg(F.approx_count_distinct("url")).first()[0] or 0
    if distinct > max_rows:
        labelled = labelled.filter(F.pmod(F.xxhash64("url"), F.lit(1 << 30)) < int((1 << 30) * max_rows / distinct))
    counted = labelled.groupBy("url", "block").agg(F.count(F.lit(1)).alias("times"))
    got = sorted(add_features(counted).select("url", "suffix", "host", "block", "times", *FEATURES[:-1]).collect(), key=lambda r: (r[0] or "", r[3]))
    if not got:
        return Model(-1.0, [], {})
    y, weight = np.array([r[3] for r in got], float), np.array([r[4] for r in got], float)
    weight /= weight.mean()
    suffixes = [r[1] for r in got]
    x = np.array([r[5:] for r in got], float)
    x = np.hstack([x, other_odds(suffixes, [r[2] for r in got], y, weight)[:, None]])
    return Model(*boost(x, y, weight), _odds(suffixes, y, weight))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, max_rows: int = FIT_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict and the trees' probability of `block`.

    URLs that a rule decides are the labelled ones that the trees learn from.
    """
    base = pages.select("page_id", "url")
    host, path = host_and_path(F.col("url"))
    labelled = base.select("url", matching_rule(host, path, rules, "verdict").alias("v")).filter("v is not null")
    model = fit(labelled.select("url", (F.col("v") == "block").cast("int").alias("block")), max_rows)
    rows = add_features(base)
    rows = rows.withColumn("score", 1 / (1 + F.exp(-model.score())))
    h, p = F.col("host"), F.col("path")
    verdict = F.coalesce(matching_rule(h, p, rules, "verdict"), F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", matching_rule(h, p, rules, "text").alias("rule"), verdict.alias("verdict"), "score")
