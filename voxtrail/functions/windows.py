"""Small window and row helpers that several operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from voxtrail.session import pin

#: Bins of a key's histogram, and parts in which its values meet the bounds.
BINS = 64
SALTS = 16


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by `order`."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def gradient(df: DataFrame, value: str, along: str, plane: list[str], out: str) -> DataFrame:
    """Central differences of `value` along one axis, one-sided at the edges; a line of one point has gradient 0."""
    w = Window.partitionBy(*plane).orderBy(along)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    step = F.when(before.isNull(), after - F.col(value)).when(after.isNull(), F.col(value) - before).otherwise((after - before) / 2)
    return df.withColumn(out, F.coalesce(step, F.lit(0.0)))


def quantiles(df: DataFrame, value: str, keys: list[str], shares: list[float], times: str | None = None) -> DataFrame:
    """Exact quantiles (linear between ranks) of each key as array __p, with least and greatest value; a row stands for `times` rows.

    Distinct values are counted first, and the counts written once.  A histogram whose BINS bounds come from a sketch of them says which bins hold the
    ranks; only these bins' values are put in order, each bin by itself, so no task orders a key's values.
    """
    counts = pin(df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg((F.count(F.lit(1)) if times is None else F.sum(times)).alias("__n")))
    inner = [F.lit(i / BINS) for i in range(1, BINS)]
    # A sketch depends on the order in which its parts arrive, so bounds are written too: the bins counted are those that are put in order.
    totals = pin(counts.groupBy(*keys).agg(F.sum("__n").alias("__all"), F.min(value).alias("__min"), F.max(value).alias("__max"), F.percentile_approx(value, F.array(*inner), 10 * BINS).alias("__cuts")))
    # A key's counts meet its bounds in SALTS parts.
    salted = totals.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    binned = counts.withColumn("__salt", F.pmod(F.xxhash64(value), F.lit(SALTS)).cast("int")).join(salted, [*keys, "__salt"])
    binned = binned.withColumn("__bin", F.size(F.filter("__cuts", lambda c: c < F.col(value)))).drop("__cuts", "__salt")
    sizes = binned.groupBy(*keys, "__bin").agg(F.sum("__n").alias("__size"), F.first("__all").alias("__all"))
    before = F.sum("__size").over(Window.partitionBy(*keys).orderBy("__bin")) - F.col("__size")
    ranks = [F.lit(s) * (F.col("__all") - 1) for s in shares]
    holds = reduce(lambda a, b: a | b, [(f(r) >= F.col("__before")) & (f(r) < F.col("__before") + F.col("__size")) for r in ranks for f in (F.floor, F.ceil)])
    needed = sizes.withColumn("__before", before).filter(holds).select(*keys, "__bin", "__before")
    up_to = F.col("__before") + F.sum("__n").over(Window.partitionBy(*keys, "__bin").orderBy(value))
    line = binned.join(needed, [*keys, "__bin"]).withColumn("__up", up_to)
    at = lambda rank: F.min(F.when(F.col("__up") > rank, F.col(value)))
    ends = line.groupBy(*keys, "__all", "__min", "__max").agg(*[at(f(r)).alias(f"__{n}{i}") for i, r in enumerate(ranks) for n, f in (("a", F.floor), ("b", F.ceil))])
    mixed = [F.col(f"__a{i}") + (F.col(f"__b{i}") - F.col(f"__a{i}")) * (r - F.floor(r)) for i, r in enumerate(ranks)]
    return ends.select(*keys, F.array(*[m.cast("double") for m in mixed]).alias("__p"), "__min", "__max")


def percentiles(df: DataFrame, value: str, keys: list[str], low: float, high: float) -> DataFrame:
    """Two percentiles (in percent) of each key, as `quantiles`."""
    return quantiles(df, value, keys, [low / 100, high / 100])
