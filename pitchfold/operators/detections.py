"""Stateless work on detections: source filter, class split, player filter, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BALL, PLAYER, Tracking
from ..functions.geometry import CORNERS, box, center, truncated, valid_player_box
from ..sources.tables import FPS, HEIGHT, WIDTH, finite, frame_spine, is_finite, start_frame, tracker_ids, with_meta, without_meta


def source_filter(detections: DataFrame, config: Tracking = Tracking()) -> DataFrame:
    """What a detector that is asked for people and balls above its floor returns; boxes that aren't finite go."""
    return finite(detections).withColumn("cls", F.col("cls").cast("int")).where(F.col("cls").isin(PLAYER, BALL) & (F.col("conf") >= config.min_confidence))


def is_kept(config: Tracking = Tracking()) -> Column:
    """The condition of ``source_filter``, for counts over all rows."""
    return is_finite() & F.col("cls").cast("int").isin(PLAYER, BALL) & (F.col("conf") >= config.min_confidence)


def is_player(config: Tracking = Tracking()) -> Column:
    """The condition of ``valid_players`` on rows ``with_meta``."""
    return is_kept(config) & (F.col("cls").cast("int") == PLAYER) & valid_player_box(config, size=(F.col(WIDTH), F.col(HEIGHT)))


def from_start(detections: DataFrame, first_frame: int) -> DataFrame:
    """Detections from a frame on; over a stored table the scan gets the filter and skips row groups."""
    return detections.where(F.col("frame") >= first_frame)


def from_start_minute(detections: DataFrame, meta: DataFrame, config: Tracking = Tracking()) -> DataFrame:
    """Detections from the start minute on; which frame that is follows from each match's rate."""
    rows = with_meta(detections, meta, config)
    return without_meta(rows.where(F.col("frame") >= start_frame(F.col(FPS), config)))


def split(detections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Players and balls; other classes go."""
    return detections.where(F.col("cls") == PLAYER), detections.where(F.col("cls") == BALL)


def valid_players(detections: DataFrame, config: Tracking = Tracking(), meta: DataFrame | None = None) -> DataFrame:
    """Players inside the margins of their match's picture; its size is in ``meta``, or the configuration's."""
    players = split(source_filter(detections, config))[0]
    if meta is None:
        return players.where(valid_player_box(config))
    return without_meta(with_meta(players, meta, config).where(valid_player_box(config, size=(F.col(WIDTH), F.col(HEIGHT)))))


def player_tracks(detections: DataFrame, config: Tracking = Tracking(), meta: DataFrame | None = None) -> DataFrame:
    """Valid players that carry a tracker id, corners as whole numbers, one row an id and frame."""
    rows = valid_players(detections, config, meta).select("match_id", "frame", "ord", "tid", *[truncated(c).alias(c) for c in CORNERS])
    return tracker_ids(rows).select("match_id", "frame", "ord", "tid", *CORNERS)


def with_centers(rows: DataFrame) -> DataFrame:
    x1, y1, x2, y2 = box()
    return rows.withColumns({"cx": center(x1, x2), "cy": center(y1, y2)})


def frame_counts(detections: DataFrame, config: Tracking = Tracking(), meta: DataFrame | None = None) -> DataFrame:
    """(match_id, frame, n_dets_raw, n_dets) for every frame: all of both classes, and valid players."""
    rows = with_meta(detections, meta, config)
    counts = rows.groupBy("match_id", "frame").agg(F.count_if(is_kept(config)).alias("n_dets_raw"), F.count_if(is_player(config)).alias("n_dets"))
    return every_frame(counts, ["n_dets_raw", "n_dets"])


def every_frame(counts: DataFrame, zeros: list[str]) -> DataFrame:
    """Rows (match_id, frame, ...) and those of the frames between them, where ``zeros`` are 0 and the rest is as in the frame before."""
    after = F.lead("frame").over(Window.partitionBy("match_id").orderBy("frame"))
    spread = counts.withColumn("after", after).select("*", F.posexplode(F.sequence("frame", F.coalesce(F.col("after") - 1, F.col("frame")))).alias("nth", "at"))
    values = [F.when(F.col("nth") == 0, F.col(c)).otherwise(F.lit(0)).alias(c) if c in zeros else F.col("at").alias(c) if c == "frame" else F.col(c) for c in counts.columns]
    return spread.select(*values)


def frames_without_tracks(detections: DataFrame, tracks: DataFrame) -> DataFrame:
    """(match_id, frames, frames_without_tracks)."""
    spine = frame_spine(detections)
    seen = tracks.select("match_id", "frame").distinct().withColumn("seen", F.lit(True))
    return spine.join(seen, ["match_id", "frame"], "left").groupBy("match_id").agg(F.count(F.lit(1)).alias("frames"), F.count_if(F.col("seen").isNull()).alias("frames_without_tracks"))
