"""Run counters that come with a write: observed metrics, and a listener that adds up those of a stream.

Counting what is written costs no scan of its own. A batch takes the counters
from its ``Observation``; a stream sends them with each micro-batch's progress.
"""

from __future__ import annotations

import threading
from collections import Counter

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators.identity import EXPORTED, TOMBSTONED
from .identity import CLOSED, LATE

TRACKS = "tracks"


def frame_counters() -> list[Column]:
    """Counters over ``metrics.frame_table``."""
    return [
        F.count(F.lit(1)).alias("frames"),
        F.count_if(F.col("n_tracks") == 0).alias("frames_without_tracks"),
        F.sum("n_dets_raw").alias("dets_raw"),
        F.sum("n_dets").alias("dets_valid"),
        F.count_if(F.col("n_balls") > 0).alias("ball_frames"),
        F.sum(F.bit_count(F.col("exported").bitwiseAND(F.bitwise_not("gone")))).alias("player_rows"),
    ]


def log_counters() -> list[Column]:
    """Counters over a resolved log, also of a stream."""
    begun = lambda outcome: F.count_if((F.col("outcome") == outcome) & ~F.col("status").isin(LATE, CLOSED)).alias(outcome)
    return [
        F.count_if(~F.col("status").isin(LATE, CLOSED)).alias("tracks"),
        F.count_if(F.col("status") == EXPORTED).alias("exported"),
        F.count_if(F.col("status") == TOMBSTONED).alias("static"),
        F.count_if(F.col("status") == LATE).alias("late"),
        F.count_if(F.col("status") == CLOSED).alias("closed"),
        *[begun(outcome) for outcome in ("new", "recycled", "reid")],
    ]


def observe_frames(frames: DataFrame) -> tuple[DataFrame, Observation]:
    """The table of frames, and what its next action will have counted."""
    seen = Observation("frames")
    return frames.observe(seen, *frame_counters()), seen


def observe_log(log: DataFrame) -> tuple[DataFrame, Observation]:
    seen = Observation("log")
    return log.observe(seen, *log_counters()), seen


def observe_stream(log: DataFrame, name: str = TRACKS) -> DataFrame:
    """A streaming log whose progress carries the counters under ``name``."""
    return log.observe(name, *log_counters())


class RunTotals(StreamingQueryListener):
    """Adds up the counters of all micro-batches; a batch that is reported twice counts once."""

    def __init__(self, name: str = TRACKS):
        self.name, self.by_batch, self.lock = name, {}, threading.Lock()

    @property
    def totals(self) -> Counter:
        with self.lock:
            return sum((Counter(c) for c in self.by_batch.values()), Counter())

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            with self.lock:
                self.by_batch[str(event.progress.id), event.progress.batchId] = {k: v or 0 for k, v in row.asDict().items()}

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
