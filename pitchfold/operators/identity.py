"""Persistent player ids: an ordered fold over the tracks of a match.

The fold is the one step that is sequential within a match. Rows are dealt out
by match, sorted by (frame, ord), and stream through ``mapInPandas``; its state
is one slot for each id, so a task needs no match as a whole in memory.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from math import sqrt, sumprod

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..config import Tracking
from ..sources.tables import by_match
from .static import without_static

EXPORTED, OCCLUDED, TOMBSTONED, HIDDEN, DROPPED = "exported", "occluded", "tombstoned", "hidden", "dropped"
NEW_EVENTS = ("new", "recycled", "reid")


@dataclass
class Slot:
    """One persistent id. A slot without a tracker id is free."""

    tid: int = 0
    x: int = 0
    y: int = 0
    frame: int = -1
    dead: bool = False
    seen: list = field(default_factory=list)
    look: list[float] | None = None


class Fold:
    """State of one match. Feed tracks in order of (frame, ord); tracker ids start at 1."""

    def __init__(self, config: Tracking = Tracking()):
        self.config = config
        self.slots = [Slot() for _ in range(config.players)]
        self.by_tid: dict[int, int] = {}
        self.frame: int | None = None
        self.active: set[int] = set()
        self.boxes: list[tuple[int, int, int, int]] = []

    @property
    def free(self) -> int:
        return len(self.slots) - len(self.by_tid)

    @property
    def static(self) -> int:
        return sum(s.dead for s in self.slots)

    def _covered(self, box: tuple[int, int, int, int]) -> bool:
        ax, ay, bx, by = box
        area = (bx - ax) * (by - ay)
        for cx, cy, dx, dy in self.boxes:
            inter = max(0, min(bx, dx) - max(ax, cx)) * max(0, min(by, dy) - max(ay, cy))
            union = area + (dx - cx) * (dy - cy) - inter
            if inter > 0 and union > 0 and inter / union > self.config.max_overlap:
                return True
        return False

    def _alike(self, slot: Slot, look: Sequence[float] | None) -> bool:
        """Whether a look may be the slot's; one that is missing or zero may be anyone's."""
        if self.config.min_cosine is None or look is None or slot.look is None or len(look) != len(slot.look):
            return True
        size = sqrt(sumprod(look, look) * sumprod(slot.look, slot.look))
        return size == 0 or sumprod(look, slot.look) >= self.config.min_cosine * size

    def _remember(self, slot: Slot, look: Sequence[float] | None, begins: bool) -> None:
        """One vector a slot: the mean of its looks, where later ones weigh more; a new owner begins anew."""
        if self.config.min_cosine is None:
            return
        if begins or slot.look is None or (look is not None and len(look) != len(slot.look)):
            slot.look = None if look is None else [float(v) for v in look]
        elif look is not None:
            k = self.config.look_kept
            slot.look = [k * a + (1 - k) * float(b) for a, b in zip(slot.look, look, strict=True)]

    def _choose(self, frame: int, tid: int, x: int, y: int, look: Sequence[float] | None) -> tuple[int | None, str, int | None]:
        """Slot for a clear track: its own, else the lowest free one, else the nearest that is absent; and how far, squared, that is."""
        k = self.by_tid.get(tid)
        if k is not None:
            return (None, "duplicate", None) if k in self.active else (k, "known", None)
        for k, slot in enumerate(self.slots):
            if slot.tid == 0:
                return k, "recycled" if slot.frame >= 0 else "new", None
        reach = []
        for k, slot in enumerate(self.slots):
            d2 = (slot.x - x) ** 2 + (slot.y - y) ** 2
            if k not in self.active and frame - slot.frame >= self.config.min_absence and d2 <= self.config.max_distance**2 and self._alike(slot, look):
                reach.append((d2, k))
        return (min(reach)[1], "reid", min(reach)[0]) if reach else (None, "unresolved", None)

    def _is_static(self, slot: Slot) -> bool:
        """Judge the window if it is full; what passes keeps its last sightings."""
        if len(slot.seen) < self.config.window:
            return False
        xs, ys = zip(*slot.seen[-self.config.window :], strict=True)
        if max(max(xs) - min(xs), max(ys) - min(ys)) < self.config.min_extent:
            return True
        del slot.seen[: -self.config.window_kept]
        return False

    def step(self, frame: int, tid: int, x1: int, y1: int, x2: int, y2: int, look: Sequence[float] | None = None) -> tuple[int, int, bool, int | None, str, str, int | None]:
        """(cx, cy, occluded, id or None, outcome, status, squared distance of a re-identification) of one track.

        ``look`` is a vector of its appearance, if there is one; that of a covered player is not used.
        """
        if frame != self.frame:
            self.frame, self.active, self.boxes = frame, set(), []
        box, x, y = (x1, y1, x2, y2), (x1 + x2) // 2, (y1 + y2) // 2
        if self._covered(box):
            k = self.by_tid.get(tid)
            if k in self.active:
                return x, y, True, None, "duplicate", DROPPED, None
            self.boxes.append(box)
            if k is None:
                return x, y, True, None, "unknown", DROPPED, None
            slot = self.slots[k]
            slot.x, slot.y, slot.frame = x, y, frame
            self.active.add(k)
            return x, y, True, k + 1, "known", OCCLUDED, None
        k, outcome, d2 = self._choose(frame, tid, x, y, look)
        if k is None:
            return x, y, False, None, outcome, DROPPED, None
        slot = self.slots[k]
        if slot.tid != tid:
            self.by_tid.pop(slot.tid, None)
            self.by_tid[tid], slot.tid = k, tid
        slot.x, slot.y, slot.frame = x, y, frame
        self.active.add(k)
        self.boxes.append(box)
        self._remember(slot, look, outcome in ("new", "recycled"))
        if slot.dead:
            return x, y, False, k + 1, outcome, HIDDEN, d2
        slot.seen.append((x, y))
        if self._is_static(slot):
            slot.dead, slot.seen = True, []
            del self.by_tid[tid]
            slot.tid = 0
            return x, y, False, k + 1, outcome, TOMBSTONED, d2
        return x, y, False, k + 1, outcome, EXPORTED, d2


_IN = ("match_id", "frame", "ord", "tid", "x1", "y1", "x2", "y2")
_OUT = ("cx", "cy", "occluded", "id", "outcome", "status", "reid_d2", "free", "static")


def resolve(tracks: DataFrame, config: Tracking = Tracking()) -> DataFrame:
    """The resolved log: every track with its center, id, outcome, status, and the counts of free and static ids after it.

    With ``min_cosine`` set, a column ``look`` of the tracks (an array, null
    where unknown) is asked beside the distance when an id is found again.
    """
    looks = ("look",) if config.min_cosine is not None else ()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        match, fold = None, Fold(config)
        for part in frames:
            out = []
            for own, frame, _, tid, *rest in part[[*_IN, *looks]].itertuples(index=False, name=None):
                if own != match:
                    match, fold = own, Fold(config)
                out.append((*fold.step(frame, tid, *rest), fold.free, fold.static))
            done = pd.DataFrame(out, columns=list(_OUT), index=part.index)
            done["id"], done["reid_d2"] = done["id"].astype("Int32"), done["reid_d2"].astype("Int64")
            yield pd.concat([part[list(_IN)], done], axis=1)

    given = [F.col("look").cast("array<double>").alias("look")] if looks else []
    ordered = by_match(tracks.select(*_IN, *given)).sortWithinPartitions("match_id", "frame", "ord")
    return ordered.mapInPandas(run, schemas.RESOLVED)


def with_looks(tracks: DataFrame, looks: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Tracks with the appearance vector of their tracker id; null for ids without one. A join by id, of repeated ids the least vector."""
    one = looks.groupBy(F.col(id_col).alias("tid")).agg(F.min(F.col(vector_col).cast("array<double>")).alias("look"))
    return tracks.join(one, "tid", "left")


def static_ids(log: DataFrame) -> DataFrame:
    """(match_id, id) of the ids that the fold took for static objects."""
    return log.where(F.col("status") == TOMBSTONED).select("match_id", "id").distinct()


def with_verdict(log: DataFrame) -> DataFrame:
    """The log with ``gone``: whether the row's id is static at the end of the match.

    The same rows as an anti join with ``static_ids`` would drop, but the log,
    and with it the fold, is read once.
    """
    return log.withColumn("gone", F.coalesce(F.max(F.col("status") == TOMBSTONED).over(Window.partitionBy("match_id", "id")) & F.col("id").isNotNull(), F.lit(False)))


def observations(log: DataFrame, emit_occluded: bool = False) -> DataFrame:
    """Player positions: (match_id, frame, id, x, y, corners, en_oclusion), static ids left out.

    By default hidden players give no row, so en_oclusion is False throughout;
    ``emit_occluded`` adds a row with True where a known player is covered.
    """
    statuses = [EXPORTED] + [OCCLUDED] * emit_occluded
    rows = with_verdict(log).where(~F.col("gone") & F.col("status").isin(statuses))
    return rows.select("match_id", "frame", "id", F.col("cx").alias("x"), F.col("cy").alias("y"), "x1", "y1", "x2", "y2", F.col("occluded").alias("en_oclusion"))


def observations_by_join(log: DataFrame) -> DataFrame:
    """``observations`` by an anti join, for a log that is a stored table."""
    kept = without_static(log.where(F.col("status") == EXPORTED), static_ids(log), "id")
    return kept.select("match_id", "frame", "id", F.col("cx").alias("x"), F.col("cy").alias("y"), "x1", "y1", "x2", "y2", F.lit(False).alias("en_oclusion"))


def events(log: DataFrame) -> DataFrame:
    """(match_id, frame, ord, tid, id, event, pool, distance): an id begins, is used again, is found again, or is static.

    ``pool`` is how many ids are free behind an id that begins or is used again,
    ``distance`` how far from its last place an id was found, in pixels.
    """
    kind = F.when(F.col("status") == TOMBSTONED, F.lit("static"))
    begun = F.when(F.col("outcome").isin(*NEW_EVENTS), F.col("outcome"))
    rows = log.select("match_id", "frame", "ord", "tid", "id", "free", "reid_d2", F.explode(F.array_compact(F.array(begun, kind))).alias("event"))
    pool, far = F.when(F.col("event").isin("new", "recycled"), F.col("free")), F.when(F.col("event") == "reid", F.round(F.sqrt(F.col("reid_d2").cast("double")), 6))
    return rows.select("match_id", "frame", "ord", "tid", "id", "event", pool.alias("pool"), far.alias("distance"))
