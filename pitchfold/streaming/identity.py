"""The identity fold over a stream of tracks, on ``transformWithStateInPandas``.

One state a match: the slots of the fold, and the tracks of frames that are not
closed. A micro-batch may bring tracks in any order, so a frame is folded only
once it is closed: a frame more than ``lag`` later has come. Tracks of frames
that are folded already are late; they come out with the status ``late``, so
they can be counted. A row with tracker id 0 is no track, but tells that its
frame has come; a source may send one after a match's last frame to close it.
Without one, a match that brought no rows for ``idle_ms`` is flushed: its open
frames are folded, and its state goes. Rows that come later begin it anew. A row with
tracker id -2 does the same at once: it ends the match. With ``tell_end`` a
match that is over comes out as a row of its own with the status ``closed``.

Rows come out with the verdicts of their time. A static object is told by its
``tombstoned`` row; its earlier rows go when the written log is compacted with
``operators.identity.observations``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .. import schemas
from ..config import Tracking
from ..operators.identity import Fold, Slot

LATE, CLOSED = "late", "closed"
#: Tracker id of a row that ends its match.
END = -2
_TRACK = ["frame", "ord", "tid", "x1", "y1", "x2", "y2"]
_OUT = ["match_id", *_TRACK, "cx", "cy", "occluded", "id", "outcome", "status", "reid_d2", "free", "static"]
#: ``newest``: largest frame that has come; ``folded``: largest frame that is folded.
STATE = "newest bigint, folded bigint, tid array<bigint>, x array<bigint>, y array<bigint>, frame array<bigint>, dead array<boolean>, seen array<array<bigint>>, look array<array<double>>"
PENDING = ", ".join(f"{c} bigint" for c in _TRACK) + ", look array<double>"


def dump(fold: Fold) -> tuple:
    """Slots as plain lists; the sightings of a slot as x, y, x, y ..."""
    s = fold.slots
    return [x.tid for x in s], [x.x for x in s], [x.y for x in s], [x.frame for x in s], [x.dead for x in s], [[v for p in x.seen for v in p] for x in s], [x.look for x in s]


def load(config: Tracking, tid: list, x: list, y: list, frame: list, dead: list, seen: list, look: list) -> Fold:
    fold = Fold(config)
    fold.slots = [Slot(int(t), int(a), int(b), int(f), bool(d), list(zip(map(int, s[::2]), map(int, s[1::2]), strict=True)), None if v is None else [float(e) for e in v]) for t, a, b, f, d, s, v in zip(tid, x, y, frame, dead, seen, look, strict=True)]
    fold.by_tid = {s.tid: k for k, s in enumerate(fold.slots) if s.tid}
    return fold


def _folded(match: int, fold: Fold, rows: list[tuple]) -> list[tuple]:
    return [(match, *row[:-1], *fold.step(row[0], *row[2:]), fold.free, fold.static) for row in rows]


def _row(row: tuple) -> tuple:
    """A track with plain values, its look last."""
    return (*map(int, row[:-1]), None if row[-1] is None else tuple(map(float, row[-1])))


def _in_order(rows) -> list[tuple]:
    return sorted(rows, key=lambda r: r[:-1])


def _frame(out: list[tuple]) -> pd.DataFrame:
    done = pd.DataFrame(out, columns=_OUT)
    done["ord"], done["id"], done["reid_d2"] = done["ord"].astype("Int64"), done["id"].astype("Int32"), done["reid_d2"].astype("Int64")
    return done


class IdentityProcessor(StatefulProcessor):
    def __init__(self, config: Tracking = Tracking(), lag: int = 0, idle_ms: int | None = None, tell_end: bool = False):
        self.config, self.lag, self.idle_ms, self.tell_end = config, lag, idle_ms, tell_end

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("fold", STATE)
        self.pending = handle.getListState("pending", PENDING)

    def _held(self) -> tuple[int, int, Fold]:
        if self.state.exists():
            newest, folded, *slots = self.state.get()
            return newest, folded, load(self.config, *slots)
        return -1, -1, Fold(self.config)

    def _wait(self, timers) -> None:
        """One timer a match, ``idle_ms`` from now."""
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at if isinstance(at, int) else at[0])
        self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        match = int(key[0])
        newest, folded, fold = self._held()
        out, new, ends = [], [], False
        for part in rows:
            for row in part[[*_TRACK, "look"]].itertuples(index=False, name=None):
                row = _row(row)
                newest = max(newest, row[0])
                if row[2] < 1:
                    ends |= row[2] == END
                    continue
                if row[0] <= folded:
                    out.append((match, *row[:-1], (row[3] + row[5]) // 2, (row[4] + row[6]) // 2, False, None, LATE, LATE, None, fold.free, fold.static))
                else:
                    new.append(row)
        if ends:
            yield _frame(out + self._over(match, newest, fold, new))
            return
        closed = newest - self.lag - 1
        if closed > folded:  # else no frame closes, and what waits is left alone
            held = [*(_row(tuple(r)) for r in self.pending.get()), *new]
            out += _folded(match, fold, _in_order(r for r in held if r[0] <= closed))
            if held := [r for r in held if r[0] > closed]:
                self.pending.put(held)
            else:
                self.pending.clear()
        elif new:
            self.pending.appendList(new)
        self.state.update((newest, max(folded, closed), *dump(fold)))
        if self.idle_ms is not None:
            self._wait(timerValues)
        yield _frame(out)

    def _over(self, match: int, newest: int, fold: Fold, new: list[tuple]) -> list[tuple]:
        """Fold what is left of a match, and forget it."""
        out = _folded(match, fold, _in_order([*(_row(tuple(r)) for r in self.pending.get()), *new]))
        self.pending.clear()
        self.state.clear()
        for at in list(self.handle.listTimers()) if self.idle_ms is not None else ():
            self.handle.deleteTimer(at if isinstance(at, int) else at[0])
        if self.tell_end:
            out.append((match, newest, None, 0, 0, 0, 0, 0, 0, 0, False, None, CLOSED, CLOSED, None, fold.free, fold.static))
        return out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The match went silent."""
        newest, _, fold = self._held()
        yield _frame(self._over(int(key[0]), newest, fold, []))

    def close(self) -> None:
        pass


def read_tracks(spark: SparkSession, path: str, files_per_batch: int = 100, looks: bool = False) -> DataFrame:
    """Tracks as files of a folder bring them, with ``looks`` also their appearance."""
    return spark.readStream.schema(schemas.TRACKS_PLAYER + ", look array<double>" * looks).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def resolve_stream(tracks: DataFrame, config: Tracking = Tracking(), lag: int = 0, idle_ms: int | None = None, tell_end: bool = False) -> DataFrame:
    """The resolved log of ``operators.identity.resolve`` over a stream, in append mode.

    Needs the RocksDB state store. Frames of one match share a state, matches
    are independent, so it scales with the number of matches. With ``idle_ms``,
    matches that went silent are flushed and leave the state store; without, a
    row of tracker id 0 closes a match's last frames and its state stays.
    """
    mode = "none" if idle_ms is None else "processingTime"
    look = F.col("look").cast("array<double>") if config.min_cosine is not None else F.lit(None).cast("array<double>")
    tracks = tracks.select("match_id", *_TRACK, look.alias("look"))
    return tracks.groupBy("match_id").transformWithStateInPandas(IdentityProcessor(config, lag, idle_ms, tell_end), outputStructType=schemas.RESOLVED, outputMode="append", timeMode=mode)


def open_matches(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What the state store holds of matches that are not over: match_id, newest and folded frame, the slots' tracker ids, waiting tracks."""
    source = lambda name: spark.read.format("statestore").option("stateVarName", name)
    folds = source("fold").load(checkpoint).select(F.col("key.match_id").alias("match_id"), "value.newest", "value.folded", "value.tid")
    waiting = source("pending").load(checkpoint).groupBy(F.col("key.match_id").alias("match_id")).agg(F.count(F.lit(1)).alias("waiting"))
    return folds.join(waiting, "match_id", "left").na.fill(0, ["waiting"])
