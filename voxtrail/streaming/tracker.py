"""The tracker over a stream of detections, and windowed sums of displacements (an extension).

Frames of a movie must arrive in order of t; a frame's rows come together once the watermark
has passed it.  The state of a movie is its tracker's arrays, which are bounded by the tracks
active within `max_gap` frames; a movie that stays silent is dropped after `idle_ms`, if given.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from voxtrail.operators.tracking import POINT, Config, State, Tracker, frames_of

OUTPUT = "movie string, " + POINT


def track_stream(detections: DataFrame, config: Config = Config(), idle_ms: int | None = None) -> DataFrame:
    """Track points of a stream of detections (movie, t, cell_id, z_um, y_um, x_um)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        arrays, last = pickle.loads(state.get[0]) if state.exists else ({}, -1)
        tracker, rows = Tracker(config, State(**arrays)), []
        for frame in frames_of(pd.concat(list(batches), ignore_index=True)):
            if frame.t <= last:
                continue  # late: the tracker has no rule for going back
            last = frame.t
            rows += [(key[0], tid, frame.t, int(frame.cells[k]), *frame.places[k], margin, swaps) for tid, k, margin, swaps in tracker.feed(frame)]
        state.update((pickle.dumps((vars(tracker.state), last)),))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(rows, columns=["movie", "track_id", "t", "cell_id", "z_um", "y_um", "x_um", "margin", "swaps"])

    return detections.groupBy("movie").applyInPandasWithState(step, OUTPUT, "data binary", "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)


def windowed_displacement(flow: DataFrame, time: str, length: str = "5 minutes", slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Sums of displacements over sliding windows of event time, by movie."""
    w = flow.withWatermark(time, late).groupBy(F.window(time, length, slide), "movie")
    return w.agg(F.sum("u").alias("u"), F.sum("v").alias("v"), F.count(F.lit(1)).alias("n"))
