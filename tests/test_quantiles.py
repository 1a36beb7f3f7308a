"""Bounds of bins come from a sketch, which may differ from one reading to the next: it is made once."""

from pyspark.sql import functions as F

from voxtrail.functions.windows import quantiles


def test_bounds_are_sketched_once(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("k"), F.pmod(F.xxhash64("id"), F.lit(900)).alias("v"))
    found = quantiles(df, "v", ["k"], [0.5])
    assert "percentile_approx" not in found._jdf.queryExecution().executedPlan().toString()
    exact = {r.k: r.p for r in df.groupBy("k").agg(F.percentile("v", F.lit(0.5)).alias("p")).collect()}
    assert {r.k: r["__p"][0] for r in found.collect()} == exact
