"""One query for each operator, over the detections that ``events`` stands for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Tracking
from ..functions.geometry import CORNERS
from ..operators import association, ball, cameras, detections, ext, identity, metrics, overlap, report, static
from ..sources import tables

#: The synthetic video begins at minute 20; this start cuts some of it off.
LATER = Tracking(start_minute=20.25)
#: Matches of the queries with metadata, in events, and a start that cuts some of each match off.
SHORT_MATCH, EARLIER = 1000, Tracking(start_minute=16.07)
#: Where the right camera's picture begins and the left one's ends; how far apart two positions of one player may be.
CAMERAS, REACH = (300, 500), 8.0
LOOKS = Tracking(min_cosine=0.3)
#: An affine map with a slight perspective, for the extension's query.
HOMOGRAPHY = ((0.05, 0.002, -2.0), (0.001, 0.06, -1.5), (0.0, 0.0001, 1.0))


def _source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.detections(spark, sf_dir)


def _tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections.player_tracks(_source(spark, sf_dir))


def _balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections.split(detections.source_filter(_source(spark, sf_dir)))[1]


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.resolve(_tracks(spark, sf_dir))


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.observations(_log(spark, sf_dir))


def det_source_filter(spark, sf_dir):
    return detections.source_filter(_source(spark, sf_dir))


def start_frame_prune(spark, sf_dir):
    first = int(LATER.start_minute * 60 * LATER.fps)
    return detections.from_start(tables.detections(spark, sf_dir, first), first)


def video_meta_derived(spark, sf_dir):
    return tables.video_meta_derived(tables.video_meta(_source(spark, sf_dir), LATER), LATER)


def det_class_split(spark, sf_dir):
    players, balls = detections.split(_source(spark, sf_dir))
    return players.withColumn("route", F.lit("player")).unionByName(balls.withColumn("route", F.lit("ball")))


def player_geometry_filter(spark, sf_dir):
    return detections.valid_players(_source(spark, sf_dir))


def frame_detection_counts(spark, sf_dir):
    return detections.frame_counts(_source(spark, sf_dir))


def frames_without_tracks(spark, sf_dir):
    return detections.frames_without_tracks(_source(spark, sf_dir), _tracks(spark, sf_dir))


def track_centers(spark, sf_dir):
    return detections.with_centers(_tracks(spark, sf_dir))


def box_iou_pairs(spark, sf_dir):
    return overlap.overlaps(_tracks(spark, sf_dir)).withColumn("iou", F.round("iou", 9))


def occlusion_candidates(spark, sf_dir):
    return overlap.occlusion_candidates(_tracks(spark, sf_dir))


def nearest_absent_track(spark, sf_dir):
    return overlap.nearest_absent_track(_tracks(spark, sf_dir))


def ball_best_per_frame(spark, sf_dir):
    return ball.best_ball(_balls(spark, sf_dir)).select("match_id", "frame", "x", "y", "conf", "ord", *CORNERS)


def ball_detection_rate(spark, sf_dir):
    return ball.detection_rate(_source(spark, sf_dir), _balls(spark, sf_dir))


def static_windows_by_track(spark, sf_dir):
    return static.static_windows(detections.with_centers(_tracks(spark, sf_dir)), "tid")


def static_tracks(spark, sf_dir):
    return static.static_keys(static_windows_by_track(spark, sf_dir), "tid")


def non_static_observations(spark, sf_dir):
    return static.without_static(detections.with_centers(_tracks(spark, sf_dir)), static_tracks(spark, sf_dir), "tid")


def identity_resolved(spark, sf_dir):
    return _log(spark, sf_dir)


def identity_events(spark, sf_dir):
    return identity.events(_log(spark, sf_dir))


def player_observations(spark, sf_dir):
    return _observed(spark, sf_dir)


def player_observations_with_occlusion(spark, sf_dir):
    return identity.observations(_log(spark, sf_dir), emit_occluded=True)


def visible_frames_per_id(spark, sf_dir):
    return metrics.visible_frames(_log(spark, sf_dir))


def static_ids(spark, sf_dir):
    return identity.static_ids(_log(spark, sf_dir))


def run_summary(spark, sf_dir):
    return metrics.run_summary(_source(spark, sf_dir), _log(spark, sf_dir))


def frame_metrics(spark, sf_dir):
    return metrics.frame_metrics(_source(spark, sf_dir), _log(spark, sf_dir))


def progress_every_150(spark, sf_dir):
    return metrics.progress(frame_metrics(spark, sf_dir))


def annotations(spark, sf_dir):
    return report.annotations(detections.valid_players(_source(spark, sf_dir)), ball.best_ball(_balls(spark, sf_dir)), _log(spark, sf_dir))


def hud(spark, sf_dir):
    return report.hud(frame_metrics(spark, sf_dir))


def progress_lines(spark, sf_dir):
    return report.progress_lines(progress_every_150(spark, sf_dir))


def event_lines(spark, sf_dir):
    return report.event_lines(identity_events(spark, sf_dir))


def summary_lines(spark, sf_dir):
    return report.summary_lines(run_summary(spark, sf_dir))


def palette_colors(spark, sf_dir):
    return report.colours_of(_observed(spark, sf_dir))


def ext_heatmap(spark, sf_dir):
    return ext.heatmap(_observed(spark, sf_dir))


def ext_distance_speed(spark, sf_dir):
    return ext.distance_speed(_observed(spark, sf_dir))


def ext_homography(spark, sf_dir):
    return ext.to_field(_observed(spark, sf_dir), HOMOGRAPHY)


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Detections of shorter matches, and their metadata: two picture sizes and two rates."""
    rows = tables.detections(spark, sf_dir, events_per_match=SHORT_MATCH)
    return rows, tables.mixed_video_meta(rows)


def meta_player_filter(spark, sf_dir):
    rows, meta = _mixed(spark, sf_dir)
    return detections.valid_players(rows, meta=meta)


def meta_start_prune(spark, sf_dir):
    rows, meta = _mixed(spark, sf_dir)
    return detections.from_start_minute(rows, meta, EARLIER)


def meta_derived(spark, sf_dir):
    return tables.video_meta_derived(_mixed(spark, sf_dir)[1], EARLIER)


def meta_frame_metrics(spark, sf_dir):
    rows, meta = _mixed(spark, sf_dir)
    return metrics.frame_metrics(rows, identity.resolve(detections.player_tracks(rows, meta=meta)), meta=meta)


def meta_run_summary(spark, sf_dir):
    rows, meta = _mixed(spark, sf_dir)
    return metrics.run_summary(rows, identity.resolve(detections.player_tracks(rows, meta=meta)), meta=meta)


def meta_distance_speed(spark, sf_dir):
    rows, meta = _mixed(spark, sf_dir)
    return ext.distance_speed(identity.observations(identity.resolve(detections.player_tracks(rows, meta=meta))), meta=meta)


def reid_by_look(spark, sf_dir):
    """Re-identification that also asks for a similar look; an embedding stands for the look of the track of its number."""
    tracks = identity.with_looks(_tracks(spark, sf_dir), tables.read_table(spark, f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return identity.resolve(tracks, LOOKS)


def two_cameras(spark, sf_dir):
    """The players as two cameras see them, one the left and one the right part of the picture, with ids of its own and a pixel off."""
    seen = _observed(spark, sf_dir).select("match_id", "frame", "id", F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py"))
    left = seen.where(F.col("px") < CAMERAS[1])
    right = seen.where(F.col("px") >= CAMERAS[0]).select("match_id", "frame", (14 - F.col("id")).alias("id"), (F.col("px") + 1).alias("px"), "py")
    return cameras.merged(left, right, REACH, Tracking().players)


def associated_tracks(spark, sf_dir):
    """Players' and balls' tracks made from detections alone, each with its own parameters."""
    players, balls = association.player_tracks(_source(spark, sf_dir)), association.ball_tracks(_source(spark, sf_dir))
    named = balls.select("match_id", "frame", "ord", "tid", *[F.col(c).cast("bigint").alias(c) for c in CORNERS]).withColumn("kind", F.lit("ball"))
    return players.withColumn("kind", F.lit("player")).unionByName(named)


def associated_observations(spark, sf_dir):
    """The whole way from detections to players: tracks, identities, static removal."""
    return identity.observations(identity.resolve(association.player_tracks(_source(spark, sf_dir))))


def associated_ball(spark, sf_dir):
    return ball.best_ball(association.ball_tracks(_source(spark, sf_dir)))


#: Filters, assignment, means of vectors and one-to-one choice are no plain SQL; tests hold these against plain loops.
ASSOCIATED = (associated_tracks, associated_observations, associated_ball, reid_by_look, two_cameras)

QUERIES = {
    f.__name__: f
    for f in (
        det_source_filter,
        start_frame_prune,
        video_meta_derived,
        det_class_split,
        player_geometry_filter,
        frame_detection_counts,
        frames_without_tracks,
        track_centers,
        box_iou_pairs,
        occlusion_candidates,
        nearest_absent_track,
        ball_best_per_frame,
        ball_detection_rate,
        static_windows_by_track,
        static_tracks,
        non_static_observations,
        identity_resolved,
        identity_events,
        player_observations,
        player_observations_with_occlusion,
        visible_frames_per_id,
        static_ids,
        run_summary,
        frame_metrics,
        progress_every_150,
        annotations,
        hud,
        progress_lines,
        event_lines,
        summary_lines,
        palette_colors,
        ext_heatmap,
        ext_distance_speed,
        ext_homography,
        meta_player_filter,
        meta_start_prune,
        meta_derived,
        meta_frame_metrics,
        meta_run_summary,
        meta_distance_speed,
        *ASSOCIATED,
    )
}
