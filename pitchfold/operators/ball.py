"""The ball: one position a frame, the one with the largest confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import CORNERS, truncated
from ..sources.tables import frame_spine
from .detections import with_centers


def best_ball(balls: DataFrame) -> DataFrame:
    """(match_id, frame, ord, conf, corners, x, y); the first of equals by ``ord``.

    Ranks whatever rows it is given: tracks, or detections where no tracker ran.
    """
    order = F.struct("conf", -F.col("ord"))
    best = F.max_by(F.struct("ord", "conf", *[truncated(c).alias(c) for c in CORNERS]), order)
    rows = balls.groupBy("match_id", "frame").agg(best.alias("b")).select("match_id", "frame", "b.*")
    return with_centers(rows).withColumnsRenamed({"cx": "x", "cy": "y"})


def detection_rate(detections: DataFrame, balls: DataFrame) -> DataFrame:
    """(match_id, frames, ball_frames, ball_rate)."""
    found = balls.select("match_id", "frame").distinct().withColumn("ball", F.lit(True))
    flags = frame_spine(detections).join(found, ["match_id", "frame"], "left").withColumn("ball", F.col("ball").isNotNull())
    return flags.groupBy("match_id").agg(F.count(F.lit(1)).alias("frames"), F.count_if("ball").alias("ball_frames")).withColumn("ball_rate", F.col("ball_frames") / F.col("frames"))
