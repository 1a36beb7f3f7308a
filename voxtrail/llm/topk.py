"""Exact top-k inner products by block-at-a-time pruning.

Vectors are quantised to integers and stored in document-range blocks: BLOCK rows
of consecutive ids with each component's least and greatest value and a forward
index, the rows themselves.  For a query, a block's bound is the sum over components
of the larger product with those two values.  A query visits blocks by descending
bound, scoring each through its forward index, until the bound falls below its kth
best score; what it leaves out cannot be among its best, so results are exact.

Queries travel in groups of QUERIES rows to ranges of RANGE blocks: each pair of
group and range is one row of work, whose answer is k rows for each query.  No pair
of single rows is ever made by a join, and a last merge keeps k of each query's answers.

Defined cases: vectors that are null or hold null or non-finite components take no
part, nor do rows with a null id; shorter vectors count as if filled with zeros; a
query is not compared to rows of its own id; ties go to the smaller id, and of
repeated ids each row counts; with fewer candidates than k, all are returned; queries of one id share
one list of k, the best rows for any of their vectors; an empty table gives no rows; further columns are left out, and
their names do not matter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from voxtrail.llm.common import range_buckets, range_key

BLOCK = 256
RANGE = 32
QUERIES = 4096
MOST = 100_000
_EXACT = 2.0**53


def quantise(rows: DataFrame, vector: str, scale: int = 256) -> DataFrame:
    """Replaces `vector` by floor(scale * x) of its components as array<long>; drops rows that take no part."""
    v = F.col(vector)
    fine = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.coalesce(fine, F.lit(False))).withColumn(vector, F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _matrix(arrays: pd.Series) -> np.ndarray:
    width = max((len(a) for a in arrays), default=0)
    out = np.zeros((len(arrays), width), np.int64)
    for i, a in enumerate(arrays):
        out[i, : len(a)] = a
    return out


def _wide(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def _products(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Exact integer inner products; in floating point where every partial sum fits in 53 bits."""
    reach = float(np.abs(q).max(initial=0)) * float(np.abs(m).max(initial=0)) * q.shape[1]
    if reach < _EXACT:
        return (q.astype(np.float64) @ m.T.astype(np.float64)).astype(np.int64)
    return q @ m.T


class Blocks:
    """Document-range blocks of one range of ids."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, size: int = BLOCK) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows, self.starts = ids[order], rows[order], np.arange(0, len(ids), size)
        self.size = size
        self.least = np.stack([self.rows[i : i + size].min(0) for i in self.starts])
        self.most = np.stack([self.rows[i : i + size].max(0) for i in self.starts])

    def search(self, qids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(query number, id, score) of each query's k best rows, and how many (query, block) pairs were scored."""
        width = max(q.shape[1], self.rows.shape[1])
        q, rows = _wide(q, width), _wide(self.rows, width)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        bound = _products(up, _wide(self.most, width)) + _products(down, _wide(self.least, width))
        order = np.argsort(-bound, 1, kind="stable")
        best = np.full((len(q), k), np.iinfo(np.int64).min)
        ids = np.full((len(q), k), np.iinfo(np.int64).max)
        live, scored = np.arange(len(q)), 0
        for turn in range(len(self.starts)):
            at = order[live, turn]
            open_ = bound[live, at] >= best[live, -1]  # an equal bound may still win a tie by a smaller id
            live, at = live[open_], at[open_]
            if not len(live):
                break
            scored += len(live)
            for block in np.unique(at):
                who = live[at == block]
                a = self.starts[block]
                some = self.ids[a : a + self.size]
                score = _products(q[who], rows[a : a + self.size])
                own = some[None, :] == qids[who, None]
                score[own] = np.iinfo(np.int64).min
                both = np.hstack([best[who], score])
                names = np.hstack([ids[who], np.where(own, np.iinfo(np.int64).max, some[None, :])])
                pick = np.lexsort((names, -np.maximum(both, -(1 << 62))), axis=1)[:, :k]
                best[who], ids[who] = np.take_along_axis(both, pick, 1), np.take_along_axis(names, pick, 1)
        who, rank = np.nonzero(best > np.iinfo(np.int64).min)
        return who, ids[who, rank], best[who, rank], scored


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best rows of `vectors`, both as quantised integers."""
    base = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).filter("id is not null")
    asked = queries.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).filter("id is not null").distinct()
    range_, ranges = range_buckets(base, range_key("id", F.xxhash64("v")), BLOCK * RANGE, MOST)
    group, groups = range_buckets(asked, range_key("id", F.xxhash64("v")), QUERIES, MOST)

    # Each side is dealt to all groups of the other; a pair of a group and a range meets in one task.
    left = asked.select(group.alias("group"), F.explode(F.sequence(F.lit(0), F.lit(ranges - 1))).alias("range"), "id", "v")
    right = base.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), range_.alias("range"), "id", "v")

    def meet(some: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(some) or not len(rows):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        qids = some.id.to_numpy()
        who, ids, score, _ = Blocks(rows.id.to_numpy(), _matrix(rows.v)).search(qids, _matrix(some.v), k)
        return pd.DataFrame({"query_id": qids[who], "vec_id": ids, "score": score})

    found = left.groupBy("group", "range").cogroup(right.groupBy("group", "range")).applyInPandas(meet, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(embeddings: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """The k nearest rows of each row whose id is divisible by `every`."""
    rows = quantise(embeddings.select("vec_id", "embedding"), "embedding")
    return top_k(rows, rows.filter(F.col("vec_id") % every == 0), k)
