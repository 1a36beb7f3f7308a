"""Parameter sweeps, ranking and distribution analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def sweep_means(trials: DataFrame, parameters: list[str], metrics: list[str]) -> DataFrame:
    """Mean of each metric for every combination of parameters."""
    return trials.groupBy(*parameters).agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(m) for m in metrics])


def sweep_margins(trials: DataFrame, a: str, b: str, metric: str) -> DataFrame:
    """Means over each parameter, over each pair of them and over all, as grouping sets."""
    return trials.cube(a, b).agg(F.avg(metric).alias(metric), F.count(F.lit(1)).alias("n"))


def sweep_heatmap(trials: DataFrame, row: str, column: str, values: list, metric: str) -> DataFrame:
    """Mean metric with one row parameter down and one across."""
    table = trials.groupBy(row).pivot(column, values).agg(F.avg(metric))
    return table.select(row, *[F.col(str(v)).alias(f"{column}_{v}") for v in values])


def combined_scores(trials: DataFrame, higher: list[str], lower: list[str]) -> DataFrame:
    """Mean of the metrics scaled to [0, 1], those better when low turned round; a constant one counts 0.5.

    The ranges are a one-row table, joined to all trials.
    """
    ranges = trials.agg(*[f(m).alias(f"{n}_{m}") for m in (*higher, *lower) for n, f in (("min", F.min), ("max", F.max))])
    out = trials.join(F.broadcast(ranges))
    total = F.lit(0.0)
    for m in (*higher, *lower):
        low, high = F.col(f"min_{m}"), F.col(f"max_{m}")
        share = (F.col(m) - low) / (high - low)
        total = total + F.when(high > low, 1 - share if m in lower else share).otherwise(0.5)
    return out.select(*trials.columns, (total / len((*higher, *lower))).alias("combined"))


def top_rows(df: DataFrame, order: list, n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def rank_auc(df: DataFrame, value: str, positive: str, keys: list[str], times: str | None = None) -> DataFrame:
    """Probability that a positive row has the greater value, ties counting half, by key; a row stands for `times` rows.

    Rows are counted by value first, so only counts are ordered; rows without a value are left out, and a row that is
    neither positive nor not counts as not.
    """
    yes, each = F.coalesce(F.col(positive), F.lit(False)), F.lit(1) if times is None else F.col(times)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(F.when(yes, each).otherwise(0)).alias("__p"), F.sum(F.when(yes, 0).otherwise(each)).alias("__q"))
    below = F.sum("__q").over(Window.partitionBy(*keys).orderBy(value)) - F.col("__q") / 2
    sums = counts.withColumn("__won", F.col("__p") * below).groupBy(*keys).agg(F.sum("__won").alias("__won"), F.sum("__p").alias("p"), F.sum("__q").alias("__q"))
    return sums.select(*keys, F.when((F.col("p") > 0) & (F.col("__q") > 0), F.col("__won") / (F.col("p") * F.col("__q"))).alias("auc"), "p", (F.col("p") + F.col("__q")).alias("n"))


def win_fraction(df: DataFrame, better: str, worse: str) -> DataFrame:
    """Share of pairs in which `better` is smaller."""
    return df.agg(F.avg((F.col(better) < F.col(worse)).cast("int")).alias("win_fraction"), F.count(F.lit(1)).alias("n"))


def cdf(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Empirical distribution function over distinct values."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys)
    return counts.withColumn("cdf", F.sum("n").over(w.orderBy(value)) / F.sum("n").over(w))


def capped_histogram(df: DataFrame, value: str, cap: int) -> DataFrame:
    """Counts by value, all from `cap` on in one."""
    return df.groupBy(F.least(F.col(value), F.lit(cap)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def sample_frames(frames: DataFrame, n: int) -> DataFrame:
    """About n frames of each movie, evenly spaced from first to last by their order."""
    w = Window.partitionBy("movie")
    ranked = frames.select("movie", "t").distinct().withColumn("i", F.row_number().over(w.orderBy("t")) - 1).withColumn("total", F.count(F.lit(1)).over(w))
    m = F.least(F.col("total"), F.lit(n))
    spread = F.when(m > 1, F.transform(F.sequence(F.lit(0), m - 1), lambda j: F.floor(j * (F.col("total") - 1) / (m - 1)).cast("int"))).otherwise(F.array(F.lit(0)))
    return ranked.filter(F.array_contains(spread, F.col("i").cast("int"))).select("movie", "t")


def split_by_movie(frames: DataFrame, ratio: float = 0.8) -> DataFrame:
    """Marks the first `ratio` of each movie's frames as training ones."""
    w = Window.partitionBy("movie")
    i, n = F.row_number().over(w.orderBy("t")), F.count(F.lit(1)).over(w)
    return frames.select("movie", "t").distinct().select("movie", "t", (i <= F.floor(n * ratio)).alias("is_train"))


def sample_sequences(planes: DataFrame, n_sequences: int, seq_len: int, seed: int = 0) -> DataFrame:
    """(movie, z, t0): evenly spaced planes, each with one start drawn by a hash of plane and seed."""
    bounds = planes.groupBy("movie").agg(F.max("z").alias("zmax"), (F.max("t") + 1).alias("n_t"))
    step = F.col("zmax") / F.lit(max(1, n_sequences - 1))
    listed = bounds.filter(F.col("n_t") >= seq_len).select("movie", "n_t", F.explode(F.transform(F.sequence(F.lit(0), F.lit(n_sequences - 1)), lambda i: F.floor(i * step).cast("int"))).alias("z"))
    return listed.select("movie", "z", F.pmod(F.xxhash64("movie", "z", F.lit(seed)), F.col("n_t") - seq_len + 1).cast("int").alias("t0"))
