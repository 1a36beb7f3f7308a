"""Vector operators over arrays of doubles: affinity, neighbours and contrastive terms."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Rows whose distances to all of their patch are held at once.
ROWS = 128


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a: Column, eps: float = 1e-5) -> Column:
    return F.transform(a, lambda x: x / (norm(a) + eps))


def cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    return dot(a, b) / ((norm(a) + eps) * (norm(b) + eps))


def mean_vectors(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Mean of each component over a key, as an array again."""
    parts = df.select(*keys, F.posexplode(vector).alias("d", "x")).groupBy(*keys, "d").agg(F.avg("x").alias("x"))
    return parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias(vector))


def fragment_affinity(pixels: DataFrame, pairs: DataFrame, vector: str = "emb") -> DataFrame:
    """Cosine of the mean embeddings of each pair (a, b) of fragments."""
    means = mean_vectors(pixels, ["fragment"], vector).withColumn("n", norm(F.col(vector)) + 1e-5)
    a = means.select(F.col("fragment").alias("a"), F.col(vector).alias("va"), F.col("n").alias("na"))
    b = means.select(F.col("fragment").alias("b"), F.col(vector).alias("vb"), F.col("n").alias("nb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", (dot(F.col("va"), F.col("vb")) / (F.col("na") * F.col("nb"))).alias("affinity"))


def sample_pixels(points: DataFrame, patch: list[str], key: str, max_pixels: int = 2000) -> DataFrame:
    """The pixels that a loss takes of each patch: all, or `max_pixels` of them in the order of a multiplicative hash of integer `key`."""
    w = Window.partitionBy(*patch).orderBy(F.pmod(F.col(key) * 2654435761, F.lit(1 << 32)), key)
    return points.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= max_pixels).drop("__n")


def block_distances(points: DataFrame, patch: list[str], key: str, vector: str, blocks: int = 4, keep: list[str] = []) -> DataFrame:
    """Squared distances of all pairs of each patch's sampled pixels, made block by block of an equi-join.

    A patch has a bounded sample (`sample_pixels`), as the losses take it; patches spread over tasks.  Columns `keep` of the patch are kept.
    """
    b = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    left = points.select(*patch, F.col(key).alias("i"), F.col(vector).alias("vi"), b.alias("bi"), F.explode(every).alias("bj"))
    right = points.select(*patch, F.col(key).alias("j"), F.col(vector).alias("vj"), b.alias("bj"), F.explode(every).alias("bi"))
    pairs = left.join(right, [*patch, "bi", "bj"]).filter("i <> j")
    return pairs.select(*keep, "i", "j", dot(F.zip_with("vi", "vj", lambda x, y: x - y), F.zip_with("vi", "vj", lambda x, y: x - y)).alias("d2"), dot(F.col("vi"), F.col("vj")).alias("sim"))


def _extremes(i: np.ndarray, a: list, na: np.ndarray, j: np.ndarray, b: list, nb: np.ndarray, near: int, far: int) -> tuple[np.ndarray, ...]:
    """Places in `a` and `b`, squared distances and products (and whether these are null) of the pairs that `block_extremes` keeps of some rows.

    `j` ascends; `na` and `nb` are lengths, -1 for a vector that holds null.  Sums run over components in order, as Spark's do.
    Nulls come before all numbers and NaN after them.
    """
    width = max(map(len, [*a, *b]), default=0)
    fill = lambda rows: np.array([np.pad(np.asarray(r, float), (0, width - len(r))) for r in rows]).reshape(len(rows), width)
    va, vb = fill(a), fill(b)
    d2, sim = np.zeros((len(a), len(b))), np.zeros((len(a), len(b)))
    with np.errstate(all="ignore"):
        for x, y in zip(va.T, vb.T):
            off = x[:, None] - y[None]
            d2 += off * off
            sim += x[:, None] * y[None]
    none, same = (na[:, None] != nb[None]) | (na < 0)[:, None], i[:, None] == j[None]
    kept = np.zeros(d2.shape, bool)
    for k, sign in ((near, 1.0), (far, -1.0)):
        # nearest first: null, numbers, NaN, no pair; farthest first: NaN, numbers, null, no pair
        kind = np.select([same, none, np.isnan(d2)], [3, 1 - sign, 1 + sign], 1)
        price = np.where(kind == 1, d2 * sign, 0.0)
        plain = not (kind == 0).any() and not (kind == 2).any() and np.isfinite(price).all()
        order = np.argsort(np.where(same, np.inf, price), 1, kind="stable") if plain else np.lexsort((price, kind), axis=1)
        np.put_along_axis(kept, order[:, :k], True, 1)
    r, c = np.nonzero(kept & ~same)
    return r, c, d2[r, c], sim[r, c], none[r, c]


def block_extremes(points: DataFrame, patch: list[str], key: str, vector: str, near: int, far: int, blocks: int = 4, keep: list[str] = []) -> DataFrame:
    """Of `block_distances` each i's `near` nearest and `far` farthest pairs of its patch, ties to the smaller j; no other pair leaves the arrays of a block.

    A block of a patch meets the patch's bounded sample in one group, so what is sorted later grows with the sample and not with its square.
    Rows without a key or a vector are in no pair.
    """
    points = points.filter(F.col(key).isNotNull() & F.col(vector).isNotNull())
    kinds = dict(points.dtypes)
    names = [f"k{n}" for n in range(len(patch))]
    rows = points.select(*[F.col(c).alias(n) for c, n in zip(patch, names)], F.col(key).alias("key"), F.col(vector).alias("v"), F.when(F.exists(vector, lambda x: x.isNull()), -1).otherwise(F.size(vector)).alias("size"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def one(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", kind="stable")
        j, b, size = pdf.key.to_numpy(), pdf.v.tolist(), pdf["size"].to_numpy()
        mine, out = np.flatnonzero(pdf.own.to_numpy() == group[-1]), []
        for at in range(0, len(mine), ROWS):
            some = mine[at : at + ROWS]
            r, c, d2, sim, none = _extremes(j[some], [b[x] for x in some], size[some], j, b, size, near, far)
            out.append(pd.DataFrame({"i": j[some][r], "j": j[c], "d2": d2, "sim": sim, "none": none}))
        found = pd.concat(out) if out else pd.DataFrame({"i": j[:0], "j": j[:0], "d2": [], "sim": [], "none": []})
        for n, value in reversed(list(zip(names, group))):
            found.insert(0, n, value)
        return found

    schema = ", ".join([*(f"{n} {kinds[c]}" for c, n in zip(patch, names)), f"i {kinds[key]}, j {kinds[key]}, d2 double, sim double, none boolean"])
    pairs = rows.groupBy(*names, "block").applyInPandas(one, schema)
    # pandas gives NaN back as null
    number = lambda c: F.when(~F.col("none"), F.coalesce(c, F.lit(float("nan")))).alias(c)
    return pairs.select(*[F.col(n).alias(c) for c, n in zip(patch, names) if c in keep], "i", "j", number("d2"), number("sim"))


def nearest_and_farthest(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest (rank 1 to k) and k farthest (rank -1 to -k) of each i; ties go to the smaller j."""
    near, far = (Window.partitionBy("i").orderBy(o, "j") for o in (F.asc("d2"), F.desc("d2")))
    ranked = pairs.withColumn("near", F.row_number().over(near)).withColumn("far", F.row_number().over(far))
    kept = ranked.filter((F.col("near") <= k) | (F.col("far") <= k))
    ranks = F.array_compact(F.array(F.when(F.col("near") <= k, F.col("near")), F.when(F.col("far") <= k, -F.col("far"))))
    return kept.select("i", "j", "d2", "sim", F.explode(ranks).alias("rank"))


def contrastive_terms(ranked: DataFrame, margin: float = 0.5) -> DataFrame:
    """Attraction of the nearest and repulsion of the farthest, averaged."""
    pull = F.avg(F.when(F.col("rank") > 0, F.greatest(1 - F.col("sim"), F.lit(0.0))))
    push = F.avg(F.when(F.col("rank") < 0, F.greatest(margin + F.col("sim"), F.lit(0.0))))
    return ranked.agg(pull.alias("loss_pos"), push.alias("loss_neg"))


def warp_consistency(emb_t: DataFrame, emb_t1: DataFrame, flow: DataFrame, prob_threshold: float = 0.3) -> DataFrame:
    """Mean of 1 - cosine between a pixel's embedding and that of the next frame where its displacement leads.

    The target is rounded half to even and clipped to the plane; pixels at or below the threshold
    take no part.
    """
    at = ["movie", "t", "z", "y", "x"]
    top = emb_t1.groupBy("movie", "t", "z").agg(F.max("y").alias("ymax"), F.max("x").alias("xmax")).withColumn("t", F.col("t") - 1)
    moved = emb_t.filter(F.col("prob") > prob_threshold).join(flow.select("movie", F.col("t0").alias("t"), "z", "y", "x", "u", "v"), at).join(top, ["movie", "t", "z"])
    place = lambda p, d, m: F.greatest(F.lit(0), F.least(F.bround(F.col(p) + F.col(d)).cast("int"), F.col(m)))
    moved = moved.select("movie", (F.col("t") + 1).alias("t"), "z", place("y", "v", "ymax").alias("y"), place("x", "u", "xmax").alias("x"), F.col("emb").alias("e0"))
    pairs = moved.join(emb_t1.select(*at, F.col("emb").alias("e1")), at)
    return pairs.groupBy("movie", "t").agg(F.avg(1 - cosine(F.col("e0"), F.col("e1"))).alias("warp_loss"), F.count(F.lit(1)).alias("n"))
