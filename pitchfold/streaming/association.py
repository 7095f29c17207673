"""Association over a stream of detections: one state entry a track, which goes when the track's life ends.

A match's state is a map from track id to the track, a list of boxes of frames
that are not closed, and a head of a few numbers. A frame is closed once one
more than ``lag`` frames later has come; boxes of closed frames are late and are
counted in the head. What a micro-batch does to a match reads and writes its
living tracks only.

Lost tracks go from the map as frames come in. If no frames come, an event-time
timer stands at the end of the oldest life: when the watermark passes it, time
has passed for the match too, so open frames are folded and dead tracks go.
The head stays, as track ids are never used again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .. import schemas
from ..config import PLAYER_TRACKS, Association
from ..functions.geometry import CORNERS
from ..operators.association import WIDTH, Tracks, folded, sound_boxes

HEAD = "next bigint, frame bigint, newest bigint, newest_ms bigint, late bigint"
TRACK = "born bigint, last bigint, sure boolean, state array<double>"
PENDING = "frame bigint, ord bigint, " + ", ".join(f"{c} double" for c in (*CORNERS, "conf"))
_OUT = [c.split()[0] for c in schemas.ASSOCIATED.split(", ")]


class AssociationProcessor(StatefulProcessor):
    def __init__(self, config: Association, fps: float, lag: int):
        self.config, self.fps, self.lag = config, fps, lag

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", HEAD)
        self.tracks = handle.getMapState("tracks", "tid bigint", TRACK)
        self.pending = handle.getListState("pending", PENDING)

    def _load(self) -> tuple[Tracks, list[int]]:
        tracks, head = Tracks(self.config), [1, -1, -1, 0, 0]
        if self.head.exists():
            head = [int(x) for x in self.head.get()]
        tracks.next, tracks.frame = head[0], None if head[1] < 0 else head[1]
        held = sorted((int(k[0]), v) for k, v in self.tracks.iterator())
        if held:
            tracks.tid = np.array([k for k, _ in held], np.int64)
            tracks.born, tracks.last = (np.array([int(v[c]) for _, v in held], np.int64) for c in (0, 1))
            tracks.sure = np.array([bool(v[2]) for _, v in held])
            tracks.state = np.array([list(v[3]) for _, v in held], float).reshape(len(held), WIDTH)
        return tracks, head

    def _save(self, tracks: Tracks, head: list[int]) -> None:
        alive = set(tracks.tid.tolist())
        for k in [int(k[0]) for k in self.tracks.keys()]:
            if k not in alive:
                self.tracks.removeKey((k,))
        for k, born, last, sure, state in zip(tracks.tid.tolist(), tracks.born.tolist(), tracks.last.tolist(), tracks.sure.tolist(), tracks.state.tolist(), strict=True):
            self.tracks.updateValue((k,), (born, last, sure, state))
        head[0], head[1] = tracks.next, -1 if tracks.frame is None else tracks.frame
        self.head.update(tuple(head))

    def _fold(self, match: int, tracks: Tracks, rows: list[tuple]) -> list[tuple]:
        out, frames = [], {}
        for frame, *row in rows:
            frames.setdefault(frame, []).append(tuple(row))
        for frame in sorted(frames):
            out += folded(match, frame, tracks, frames[frame])
        return out

    def _ms(self, head: list[int], frame: int) -> int:
        """Event time of a frame, counted from the newest one that came."""
        return head[3] + int(np.ceil((frame - head[2]) * 1000 / self.fps))

    def _wake(self, tracks: Tracks, head: list[int], waiting: bool) -> None:
        """One timer a match: behind the last open frame, or at the end of the first life to end."""
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at if isinstance(at, int) else at[0])
        if waiting:
            self.handle.registerTimer(self._ms(head, head[2] + self.lag + 1))
        elif len(tracks.tid):
            self.handle.registerTimer(self._ms(head, int(tracks.last.min()) + self.config.buffer + 1))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tracks, head = self._load()
        new: list[tuple] = []
        done = -1 if tracks.frame is None else tracks.frame
        for part in rows:
            for frame, ms, order, *box in part[["frame", "ms", "ord", *CORNERS, "conf"]].itertuples(index=False, name=None):
                if frame <= done:
                    head[4] += 1
                else:
                    new.append((int(frame), int(order), *map(float, box)))
                if frame > head[2]:
                    head[2], head[3] = int(frame), int(ms)
        closed = head[2] - self.lag - 1
        out: list[tuple] = []
        waiting = True
        if closed > done:
            held = [(int(r[0]), int(r[1]), *map(float, r[2:])) for r in self.pending.get()] + new
            out = self._fold(int(key[0]), tracks, [r for r in held if r[0] <= closed])
            if tracks.frame is not None:
                tracks.pass_to(closed + 1)
            if held := [r for r in held if r[0] > closed]:
                self.pending.put(held)
            else:
                self.pending.clear()
            waiting = bool(held)
        elif new:
            self.pending.appendList(new)
        self._save(tracks, head)
        self._wake(tracks, head, waiting)
        yield pd.DataFrame(out, columns=_OUT)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Time went on without frames: fold what is open, and let dead tracks go."""
        tracks, head = self._load()
        held = [(int(r[0]), int(r[1]), *map(float, r[2:])) for r in self.pending.get()]
        out = self._fold(int(key[0]), tracks, held)
        self.pending.clear()
        if tracks.frame is not None:
            passed = head[2] + int((timerValues.getCurrentWatermarkInMs() - head[3]) * self.fps / 1000)
            tracks.pass_to(max(passed, head[2]) + 1)
        self._save(tracks, head)
        self._wake(tracks, head, False)
        yield pd.DataFrame(out, columns=_OUT)

    def close(self) -> None:
        pass


def associate_stream(detections: DataFrame, config: Association = PLAYER_TRACKS, fps: float = 24.0, lag: int = 0, delay: str = "10 seconds") -> DataFrame:
    """The tracks of ``operators.association.associate`` over a stream, in append mode.

    Needs the RocksDB state store and a column ``ts``, the time of the frame;
    ``delay`` is the watermark's. The same boxes are left out as in the batch.
    ``fps`` is the rate by which lives are counted while no frames come.
    """
    ms = (F.unix_millis("ts")).alias("ms")
    rows = detections.withWatermark("ts", delay)
    boxes = sound_boxes(rows, "ts").select("match_id", "frame", "ord", *CORNERS, "conf", "ts", ms)
    return boxes.groupBy("match_id").transformWithStateInPandas(AssociationProcessor(config, fps, lag), outputStructType=schemas.ASSOCIATED, outputMode="append", timeMode="eventTime")


def living_tracks(spark, checkpoint: str) -> DataFrame:
    """The state store's tracks: match_id, tid, born, last, sure; from the checkpoint of a query."""
    rows = spark.read.format("statestore").option("stateVarName", "tracks").load(checkpoint)
    return rows.select(F.col("key.match_id").alias("match_id"), F.col("user_map_key.tid").alias("tid"), F.col("user_map_value.born").alias("born"), F.col("user_map_value.last").alias("last"), F.col("user_map_value.sure").alias("sure"))
