"""The tracker over detections that arrive in any order, by event time.

All rows of a frame have that frame's time.  Frames wait in the state until the watermark has passed them, when a timer
has them tracked in order of t; so rows may come late, and in any order, by as much as the watermark allows.
As in a batch, a frame is tracked with the `swap_lookahead` frames after it in view; the last ones of a movie are when it has been idle.

State of a movie, typed: waiting frames by t; the tracker's arrays, which are bounded by the tracks
active within `max_gap` frames.  Needs Spark's RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from voxtrail.operators.tracking import POINT, Config, Frame, State, Tracker

OUTPUT = "movie string, " + POINT + ", late boolean"
COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]
#: Arrays of the tracker's state with the shape of a row.
ARRAYS = {"ids": (), "x": (6,), "p": (6, 6), "last": (), "cell": (), "shift": (3,), "colour": (3,)}
LONGS = ("ids", "last", "cell")
TRACKS = ", ".join(f"{n} array<{'bigint' if n in LONGS else 'double'}>" for n in ARRAYS) + ", next_id bigint, t int, at bigint"


class FrameTracker(StatefulProcessor):
    def __init__(self, config: Config, time: str, idle_ms: int) -> None:
        self.config, self.time, self.idle_ms = config, time, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "t int", "at bigint, cell_id array<bigint>, place array<double>")
        self.tracks = handle.getValueState("tracks", TRACKS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done = self.tracks.get()[-2] if self.tracks.exists() else None
        for pdf in rows:
            past = pdf[pdf.t <= done] if done is not None else pdf.iloc[:0]
            if len(past):  # of frames that are tracked already: given back without a track
                yield past.assign(movie=key[0], track_id=None, margin=None, swaps=None, late=True)[COLUMNS]
            for t, cells in pdf.drop(past.index).groupby("t"):
                at, ids, place = self.waiting.getValue((int(t),)) if self.waiting.containsKey((int(t),)) else (0, [], [])
                now = int(cells[self.time].max().timestamp() * 1000)
                if now > at:
                    self.handle.registerTimer(now)
                    self.handle.registerTimer(now + self.idle_ms)
                self.waiting.updateValue((int(t),), (max(at, now), [*ids, *cells.cell_id.astype(int).tolist()], [*place, *cells[["z_um", "y_um", "x_um"]].to_numpy(float).ravel().tolist()]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        ready = sorted((k[0], *v) for k, v in self.waiting.iterator())
        open_ones = [f[0] for f in ready if f[1] > passed]
        ready = [f for f in ready if not open_ones or f[0] < open_ones[0]]
        *arrays, next_id, last, seen = self.tracks.get() if self.tracks.exists() else (*[[] for _ in ARRAYS], 0, None, 0)
        seen = max([seen, *(f[1] for f in ready)])
        idle = not open_ones and passed >= seen + self.idle_ms
        frames = [self.frame(t, ids, place) for t, _, ids, place in ready]
        tracker = Tracker(self.config, State(**{n: np.array(a, np.int64 if n in LONGS else float).reshape(-1, *s) for (n, s), a in zip(ARRAYS.items(), arrays)}, next_id=next_id))
        points, ahead = [], self.config.swap_lookahead
        for i, f in enumerate(frames if idle else frames[: max(0, len(frames) - ahead)]):
            points += [(key[0], tid, f.t, int(f.cells[k]), *f.places[k], margin, swaps, False) for tid, k, margin, swaps in tracker.feed(f, frames[i + 1 : i + 1 + ahead])]
            self.waiting.removeKey((f.t,))
            last = f.t
        if last is not None:
            self.tracks.update((*[np.asarray(getattr(tracker.state, n)).ravel().tolist() for n in ARRAYS], int(tracker.state.next_id), int(last), int(seen)))
        if points:
            yield pd.DataFrame(points, columns=COLUMNS)

    def frame(self, t: int, ids: list[int], place: list[float]) -> Frame:
        """A frame's cells in order of their ids, as a batch has them."""
        cells, places = np.array(ids, np.int64), np.array(place, float).reshape(-1, 3)
        order = np.argsort(cells, kind="stable")
        return Frame(t, cells[order], places[order], np.zeros((len(cells), 3)), np.full((len(cells), 3), np.nan))

    def close(self) -> None:
        pass


def track_frames(detections: DataFrame, time: str, late: str, config: Config = Config(), idle_ms: int = 60_000) -> DataFrame:
    """Track points of a stream of detections (movie, t, cell_id, z_um, y_um, x_um and the frame's `time`), equal to those of a batch.

    Rows older than the watermark are passed over by Spark, which counts them (numRowsDroppedByWatermark).  Rows of a frame that has
    been tracked, but not older than that, are given back with `late` set and no track.  A movie that has been idle for
    `idle_ms` of event time has its last frames tracked; its tracks stay, so it may go on.  Further columns are left out; ids and places are not null.
    """
    rows = detections.select("movie", "t", "cell_id", "z_um", "y_um", "x_um", time).withWatermark(time, late)
    return rows.groupBy("movie").transformWithStateInPandas(FrameTracker(config, time, idle_ms), OUTPUT, "append", "EventTime")
