"""Joins inside a frame and with the past, always on an equality of match (and frame)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Tracking
from ..functions.geometry import box, iou, squared_distance
from .detections import with_centers


def _earlier(tracks: DataFrame):
    """Tracks as l beside those of the same frame that come before them as r."""
    left, right = tracks.alias("l"), tracks.alias("r")
    same = (F.col("l.match_id") == F.col("r.match_id")) & (F.col("l.frame") == F.col("r.frame")) & (F.col("r.ord") < F.col("l.ord"))
    return left, right, same


def overlaps(tracks: DataFrame) -> DataFrame:
    """(match_id, frame, ord, other_ord, iou) of the boxes of a frame that overlap."""
    left, right, same = _earlier(tracks)
    found = left.join(right, same).select("l.match_id", "l.frame", "l.ord", F.col("r.ord").alias("other_ord"), iou(box("l"), box("r")).alias("iou"))
    return found.where("iou > 0")


def occlusion_candidates(tracks: DataFrame, config: Tracking = Tracking()) -> DataFrame:
    """Tracks that an earlier box of the frame covers by more than the limit.

    All earlier boxes count, also those that the identity fold leaves out; so
    this holds every track that the fold finds occluded, and may hold more.
    """
    left, right, same = _earlier(tracks)
    return left.join(right, same & (iou(box("l"), box("r")) > config.max_overlap), "left_semi")


def nearest_absent_track(tracks: DataFrame, config: Tracking = Tracking()) -> DataFrame:
    """For each track that begins, the nearest track that was last seen long enough ago.

    (match_id, frame, tid, near_tid, d2); near_tid is null if none is in reach.
    A track's last position is the one strictly before the frame. Only starts of
    tracks and positions with a long enough gap (or the end) behind them meet,
    and only in cells as wide as the reach that are the same or side by side.
    """
    rows = with_centers(tracks)
    by_tid = Window.partitionBy("match_id", "tid").orderBy("frame")
    rows = rows.withColumns({"before": F.lag("frame").over(by_tid), "after": F.lead("frame").over(by_tid)})
    cell = lambda c: F.floor(F.col(c) / config.max_distance)
    around = lambda c: F.explode(F.array(*[cell(c) + k for k in (-1, 0, 1)]))
    starts = rows.where("before IS NULL").select("match_id", "frame", "tid", "cx", "cy")
    near_cells = starts.select("*", around("cx").alias("u")).select("*", around("cy").alias("v")).alias("s")
    gaps = rows.where(F.col("after").isNull() | (F.col("after") - F.col("frame") >= config.min_absence)).select("*", cell("cx").alias("u"), cell("cy").alias("v")).alias("g")
    away = (F.col("s.frame") - F.col("g.frame") >= config.min_absence) & (F.col("g.after").isNull() | (F.col("g.after") >= F.col("s.frame")))
    d2 = squared_distance(F.col("s.cx"), F.col("s.cy"), F.col("g.cx"), F.col("g.cy"))
    same_cell = (F.col("s.match_id") == F.col("g.match_id")) & (F.col("s.u") == F.col("g.u")) & (F.col("s.v") == F.col("g.v"))
    near = same_cell & (F.col("s.tid") != F.col("g.tid")) & away & (d2 <= config.max_distance**2)
    best = F.min(F.when(F.col("g.tid").isNotNull(), F.struct(d2.alias("d2"), F.col("g.tid").alias("tid"))))
    return near_cells.join(gaps, near, "left").groupBy("s.match_id", "s.frame", "s.tid").agg(best.alias("b")).select("match_id", "frame", "tid", F.col("b.tid").alias("near_tid"), F.col("b.d2").alias("d2"))
