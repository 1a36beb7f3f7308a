"""Keeps a quality report of tracks up to date while detections arrive.

    python jobs/track_quality.py --config jobs/track_quality.toml

Reads new files of the table of events as a stream that ends when all are read; its checkpoint remembers what was
taken.  OUT/detections keeps what each batch brought, by batch and frame; OUT/report has one row for each movie
and frame, partitioned by frame.  Only frames that the batch can change are computed anew: those it has rows of, the
ones before them (which cells go on) and the ones up to `max_gap` + 1 later (switches of colour).

A batch that was cut off is taken again under its number: it writes its own part of OUT/detections over, and the
frames of OUT/report over, from all detections so far, so a rerun gives the same result.  Late frames are frames like
any other.  Events without a time or a user are in no frame and are left out, which is logged; repeated events count
once, as a cell's last event in a frame stands for it.
"""

from __future__ import annotations

import logging
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from voxtrail.adapters import detections_of, frame_of
from voxtrail.operators import scoring

log = logging.getLogger("track_quality")
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"
REPORT = (
    "movie string, n_cells long, n_dim long, n_bridge long, continuity double, n_transitions long, n_switches long, n_at_gap long, switch_rate double, t int"
)
#: More frames than these in one batch are joined without a broadcast.
MOST_FRAMES = 100_000


def run(spark: SparkSession, events: str, out: str, checkpoint: str, max_gap: int = 3, files_per_batch: int = 200) -> DataFrame:
    """Takes what is new in `events` and returns the report, read back."""
    spark.createDataFrame([], REPORT).write.mode("append").partitionBy("t").parquet(f"{out}/report")
    schema = spark.read.parquet(events).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern(events))
    columns = [f"cast({c.split()[0]} as {c.split()[1]}) as {c.split()[0]}" for c in EVENTS.split(", ")]
    writer = stream.selectExpr(*columns).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.foreachBatch(lambda batch, number: take(batch, number, out, max_gap)).start()
    query.awaitTermination()
    log.info("%s: %d batches, report in %s/report", events, len([p for p in query.recentProgress if p["numInputRows"]]), out)
    return read_report(spark, out)


def pattern(path: str) -> str:
    """The path as a pattern that it alone matches: streams take folders and patterns, but no single file."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def read_report(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(REPORT).parquet(f"{out}/report")


def take(batch: DataFrame, number: int, out: str, max_gap: int) -> None:
    """Keeps a batch's events and brings the report's frames up to date that they can change."""
    spark = batch.sparkSession
    rows = batch.withColumn("t", frame_of(F.col("ts"))).filter("t is not null and user_id is not null")
    rows.repartition("t").write.mode("overwrite").partitionBy("t").parquet(f"{out}/detections/batch={number}")
    stored = f"{EVENTS}, t int"
    own = spark.read.schema(stored).parquet(f"{out}/detections/batch={number}")
    frames = own.select("t").distinct()
    changed = around(frames, 1, max_gap + 1)
    needed = around(changed, max_gap + 1, 1)
    small = F.broadcast if frames.count() <= MOST_FRAMES else lambda df: df
    kept = spark.read.schema(f"{stored}, batch long").parquet(f"{out}/detections").join(small(needed), "t", "left_semi")
    result = report(kept, max_gap).join(small(changed), "t", "left_semi").select(*[c.split()[0] for c in REPORT.split(", ")])
    result.repartition("t").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("t").parquet(f"{out}/report")
    read, taken = batch.count(), own.count()
    written = read_report(spark, out).join(small(changed), "t", "left_semi").count()
    log.info("batch %d: read %d events, left out %d without time or user, wrote %d rows of the report", number, read, read - taken, written)


def around(frames: DataFrame, before: int, after: int) -> DataFrame:
    """The frames from `before` earlier to `after` later."""
    return frames.select(F.explode(F.sequence(F.col("t") - before, F.col("t") + after)).alias("t")).distinct()


def report(events: DataFrame, max_gap: int) -> DataFrame:
    """One row for each movie and frame: cells, how many go on, and switches of colour over at most `max_gap` frames without one."""
    points = detections_of(events).select("movie", F.col("cell_id").cast("long").alias("track_id"), "t", "color_id")
    cells = points.groupBy("movie", "t").agg(F.count(F.lit(1)).alias("n_cells"), F.sum((F.col("color_id") < 0).cast("long")).alias("n_dim"))
    steps = scoring.steps(points).filter(F.col("gap") <= max_gap + 1)
    switches = steps.groupBy("movie", "t").agg(
        F.count(F.lit(1)).alias("n_transitions"), F.sum(F.col("switch").cast("long")).alias("n_switches"), F.sum(F.when(F.col("gap") > 1, F.col("switch")).otherwise(0).cast("long")).alias("n_at_gap")
    )
    rows = cells.join(scoring.frame_continuity(points).select("movie", "t", "n_bridge", "continuity"), ["movie", "t"], "left").join(switches, ["movie", "t"], "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_bridge", "n_transitions", "n_switches", "n_at_gap")]
    rate = F.when(F.col("n_transitions") > 0, F.col("n_switches") / F.col("n_transitions"))
    return rows.select("movie", "t", "n_cells", "n_dim", "continuity", rate.alias("switch_rate"), *counts)


if __name__ == "__main__":
    from jobs.settings import main

    main("track_quality", run, __doc__)
