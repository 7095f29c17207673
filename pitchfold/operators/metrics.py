"""Counts by frame and by run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import BALL, Tracking
from ..sources.tables import FPS, with_meta
from .detections import every_frame, is_kept, is_player
from .identity import EXPORTED, TOMBSTONED, observations

#: Ids of a frame travel as bits of one number.
MOST_IDS = 62
_ZEROS = ["n_dets_raw", "n_dets", "n_balls", "n_tracks", "n_active", "exported"]


def visible_frames(log: DataFrame) -> DataFrame:
    """(match_id, id, frames), most visible first; equals by id."""
    return observations(log).groupBy("match_id", "id").agg(F.count(F.lit(1)).alias("frames")).orderBy("match_id", F.desc("frames"), "id")


def frame_table(detections: DataFrame, log: DataFrame, config: Tracking = Tracking(), meta: DataFrame | None = None, balls: DataFrame | None = None) -> DataFrame:
    """Everything that is counted by frame, for every frame of a match: the table that the other reports come of.

    match_id, frame, n_dets_raw, n_dets, n_balls, n_tracks, n_active, exported
    (bits of the ids that give a row), gone (bits of the match's static ids),
    free and static (ids of the pool behind the frame's last track, carried on
    through frames without one). Balls are the ball's boxes among the
    detections, or the rows of ``balls``, such as its tracks. Detections, log
    and balls meet in one aggregation by frame.
    """
    if config.players > MOST_IDS:
        raise ValueError(f"at most {MOST_IDS} ids fit into a number")
    nothing = {"raw": F.lit(0), "valid": F.lit(0), "ball": F.lit(0), "track": F.lit(0), "ord": F.lit(None).cast("bigint"), "free": F.lit(None).cast("int"), "static": F.lit(None).cast("int"), "act": F.lit(None).cast("bigint"), "out": F.lit(None).cast("bigint"), "dead": F.lit(None).cast("bigint")}

    def rows(df: DataFrame, **values) -> DataFrame:
        return df.select("match_id", "frame", *[(F.coalesce(values[c].cast("int"), F.lit(0)) if c in ("raw", "valid", "ball", "track") and c in values else values.get(c, v)).alias(c) for c, v in nothing.items()])

    seen = with_meta(detections, meta, config)
    kinds = {"raw": is_kept(config), "valid": is_player(config)}
    if balls is None:
        kinds["ball"] = is_kept(config) & (F.col("cls").cast("int") == BALL)
    bit = F.expr("shiftleft(1L, id)")
    tracks = rows(log, track=F.lit(1), ord=F.col("ord"), free=F.col("free"), static=F.col("static"), act=bit, out=F.when(F.col("status") == EXPORTED, bit), dead=F.when(F.col("status") == TOMBSTONED, bit))
    both = rows(seen, **kinds).unionByName(tracks)
    if balls is not None:
        both = both.unionByName(rows(balls, ball=F.lit(1)))
    bits = lambda c: F.coalesce(F.bit_or(c), F.lit(0).cast("bigint"))
    frames = both.groupBy("match_id", "frame").agg(
        F.sum("raw").alias("n_dets_raw"),
        F.sum("valid").alias("n_dets"),
        F.sum("ball").alias("n_balls"),
        F.sum("track").alias("n_tracks"),
        F.max_by(F.struct("free", "static"), "ord").alias("s"),
        F.bit_count(bits("act")).cast("bigint").alias("n_active"),
        bits("out").alias("exported"),
        bits("dead").alias("dead"),
    )
    match = Window.partitionBy("match_id")
    frames = frames.withColumns({"s": F.last("s", ignorenulls=True).over(match.orderBy("frame")), "dead": F.coalesce(F.bit_or("dead").over(match), F.lit(0).cast("bigint"))})
    free, static = F.coalesce("s.free", F.lit(config.players)), F.coalesce("s.static", F.lit(0))
    frames = frames.select("match_id", "frame", *_ZEROS, F.col("dead").alias("gone"), free.alias("free"), static.alias("static"))
    return every_frame(frames, _ZEROS)


def frame_metrics(detections: DataFrame, log: DataFrame, config: Tracking = Tracking(), meta: DataFrame | None = None, balls: DataFrame | None = None) -> DataFrame:
    """(match_id, frame, n_dets_raw, n_dets, ids_assigned, n_active, n_static, ball_detected, minute) of every frame.

    ``ids_assigned`` is the pool's size less its free and its static ids, as the
    display counts them: a static id that is free again is taken off twice.
    Minutes are counted at each match's rate.
    """
    frames = with_meta(frame_table(detections, log, config, meta, balls), meta, config)
    return frames.select(
        "match_id",
        "frame",
        "n_dets_raw",
        "n_dets",
        (config.players - F.col("free") - F.col("static")).cast("bigint").alias("ids_assigned"),
        "n_active",
        F.col("static").cast("bigint").alias("n_static"),
        (F.col("n_balls") > 0).alias("ball_detected"),
        (F.col("frame") / F.col(FPS) / 60).alias("minute"),
    )


def progress(metrics: DataFrame, config: Tracking = Tracking()) -> DataFrame:
    """The frames of ``frame_metrics`` that a progress line is due at; elapsed counts from the match's first frame."""
    elapsed = F.col("frame") - F.min("frame").over(Window.partitionBy("match_id"))
    rows = metrics.withColumn("elapsed", elapsed)
    return rows.where((F.col("elapsed") > 0) & (F.col("elapsed") % config.progress_every == 0)).select("match_id", "frame", "elapsed", "minute", "ids_assigned", "n_active", "n_static", "ball_detected")


def run_summary(detections: DataFrame, log: DataFrame, config: Tracking = Tracking(), meta: DataFrame | None = None, balls: DataFrame | None = None) -> DataFrame:
    """One row a match: frames, detections, frames without tracks, ids, rows, ball frames, static ids."""
    frames = frame_table(detections, log, config, meta, balls)
    shown = F.col("exported").bitwiseAND(F.bitwise_not("gone"))
    counts = frames.groupBy("match_id").agg(
        F.count(F.lit(1)).alias("frames"),
        F.count_if(F.col("n_tracks") == 0).alias("frames_without_tracks"),
        F.sum("n_dets_raw").alias("dets_raw"),
        F.sum("n_dets").alias("dets_valid"),
        F.bit_count(F.bit_or(shown)).cast("bigint").alias("player_ids"),
        F.sum(F.bit_count(shown)).alias("player_rows"),
        F.max("gone").alias("gone"),
        F.count_if(F.col("n_balls") > 0).alias("ball_frames"),
    )
    ids = F.filter(F.sequence(F.lit(1), F.lit(config.players)), lambda k: F.getbit("gone", k) == 1)
    return counts.select(
        "match_id", "frames", "frames_without_tracks", "dets_raw", "dets_valid", "player_ids", "player_rows", F.bit_count("gone").cast("bigint").alias("static_ids"), F.array_join(ids, ",").alias("static_list"), "ball_frames"
    )
