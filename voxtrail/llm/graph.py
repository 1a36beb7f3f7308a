"""Connected components of a large graph by local contraction and alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from voxtrail.session import PART_ROWS, pin


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the nodes of some edges that are not their component's smallest one, the root."""
    names, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b, root = at[: len(a)], at[len(a) :], np.arange(len(names))
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            break
        least = np.minimum(x, y)
        np.minimum.at(root, x, least)
        np.minimum.at(root, y, least)
        while (root[root] != root).any():
            root = root[root]
    moved = np.flatnonzero(root != np.arange(len(names)))
    return names[moved], names[root[moved]]


def _contract_part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges of one part as stars; a part has about PART_ROWS edges."""
    parts = [(x.u.to_numpy(), x.v.to_numpy()) for x in batches]
    if parts:
        u, v = contract(np.concatenate([u for u, _ in parts]), np.concatenate([v for _, v in parts]))
        yield pd.DataFrame({"u": u, "v": v})


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 50) -> DataFrame:
    """(node, root) of every node with an edge; the root is the smallest node of its component.

    Each round first replaces every part's edges, about PART_ROWS of them, by stars with the same
    components; where one part holds all edges, these are the result.  Else it links every node's greater neighbours, then its
    smaller ones, to the smallest node around; edges never grow in number and become
    stars in a number of rounds that grows with the logarithm of the graph.  Rounds are
    cut by checkpoints, so a lost executor costs one round.
    """
    now = pin(edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).filter("u <> v"))
    count = now.count()
    before = None
    for _ in range(rounds):
        parts = max(1, -(-count // PART_ROWS))
        stars = now.coalesce(parts).mapInPandas(_contract_part, "u long, v long")
        if parts == 1:
            return _rooted(pin(stars))
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        now = pin(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), count)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return _rooted(now)
        before, count = state, state[0]
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _rooted(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
