"""Where rows come from: Parquet or CSV tables, or the synthetic detections made of ``events``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BALL, PLAYER, Tracking
from ..functions.geometry import CORNERS

#: Of the synthetic video.
EVENTS_PER_MATCH, EVENTS_PER_FRAME, FIRST_FRAME = 10_000, 12, 28_771


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A Parquet table, or a CSV with header if the path ends so; frames and columns are pruned by the scan."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("header", True).csv(path) if path.endswith(".csv") else reader.parquet(path)


def synthetic_detections(events: DataFrame, events_per_match: int = EVENTS_PER_MATCH) -> DataFrame:
    """A deterministic video: boxes, classes and tracker ids out of (event_id, user_id, event_type, props).

    The number in ``props`` is parsed, and the columns are computed, once a row:
    as the output of a generator, the optimizer can't copy their expressions into
    each filter and column above.
    """
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    e = events.select("event_id", (F.col("user_id") % 16).alias("slot"), "event_type", F.explode(F.array(k)).alias("k"))
    slot, k, n = F.col("slot"), F.col("k"), F.col("event_id")
    still = slot % 5 == 0
    epoch = F.floor((n + slot * 90) / 1440)
    e = e.select(
        F.floor(n / events_per_match).alias("match_id"),
        (FIRST_FRAME + F.floor(n / EVENTS_PER_FRAME)).alias("frame"),
        n.alias("ord"),
        (slot + 1 + 16 * epoch).alias("tid"),
        F.when(F.col("event_type") == "error", BALL).when(F.col("event_type") == "signup", 2).otherwise(PLAYER).alias("cls"),
        ((k + 1).cast("double") / 100).alias("conf"),
        (40 + slot * 45 + F.when(still, k % 12).otherwise(2 * k)).cast("bigint").alias("x1"),
        (35 + slot % 4 * 50 + k % 14 + F.when(still, 20).otherwise(0)).cast("bigint").alias("y1"),
        F.when(still, 30).otherwise(20 + k % 45).alias("w"),
        F.when(still, 70).otherwise(15 + k * 13 % 140).alias("h"),
    )
    box = F.struct("match_id", "frame", "ord", "tid", "cls", "conf", "x1", "y1", (F.col("x1") + F.col("w")).alias("x2"), (F.col("y1") + F.col("h")).alias("y2"))
    return e.select(F.inline(F.array(box)))


def detections(spark: SparkSession, sf_dir: str, first_frame: int | None = None, events_per_match: int = EVENTS_PER_MATCH) -> DataFrame:
    """The synthetic video, from a frame on if given: the scan then skips what lies before."""
    events = read_table(spark, f"{sf_dir}/events.parquet")
    if first_frame is not None:
        events = events.where(F.col("event_id") >= (first_frame - FIRST_FRAME) * EVENTS_PER_FRAME)
    return synthetic_detections(events, events_per_match)


def store_detections(rows: DataFrame, path: str) -> DataFrame:
    """Write detections so that frame ranges can be skipped: each match in order of its frames. Returns the stored table."""
    rows.repartition("match_id").sortWithinPartitions("match_id", "frame", "ord").write.mode("overwrite").parquet(path)
    return read_table(rows.sparkSession, path)


def is_finite() -> Column:
    """Whether no corner of a box is missing or non-finite."""
    ok = F.lit(True)
    for c in CORNERS:
        x = F.col(c).cast("double")
        ok &= x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return ok


def by_match(rows: DataFrame) -> DataFrame:
    """Dealt out by match to as many tasks as a shuffle has: a fold costs far more than its bytes, by which tasks would be put together."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "match_id")


def finite(rows: DataFrame) -> DataFrame:
    """Ingestion guard: boxes with a missing or non-finite corner go."""
    return rows.where(is_finite())


def tracker_ids(tracks: DataFrame) -> DataFrame:
    """Ingestion guard: tracker ids start at 1; the lowest ``ord`` of a repeated id in a frame stays."""
    first = F.min_by(F.struct(*[c for c in tracks.columns if c not in ("match_id", "frame", "tid")]), "ord")
    return tracks.where("tid >= 1").groupBy("match_id", "frame", "tid").agg(first.alias("r")).select("match_id", "frame", "tid", "r.*")


def frame_spine(rows: DataFrame) -> DataFrame:
    """(match_id, frame) for every frame between a match's first and last, seen or not."""
    ends = rows.groupBy("match_id").agg(F.min("frame").alias("a"), F.max("frame").alias("b"))
    return ends.select("match_id", F.explode(F.sequence("a", "b")).alias("frame"))


def video_meta(rows: DataFrame, config: Tracking = Tracking()) -> DataFrame:
    """One row a match; fps and picture size come from the configuration."""
    return rows.groupBy("match_id").agg((F.max("frame") + 1).alias("total_frames")).select("match_id", F.lit(config.fps).alias("fps"), "total_frames", F.lit(config.width).alias("width"), F.lit(config.height).alias("height"))


def video_meta_derived(meta: DataFrame, config: Tracking = Tracking()) -> DataFrame:
    """Whole fps (half to even), minutes, and the first frame to process."""
    return meta.select(
        "match_id",
        F.bround("fps").cast("bigint").alias("fps_rounded"),
        (F.col("total_frames") / F.col("fps") / 60).alias("minutes"),
        start_frame(F.col("fps"), config).alias("start_frame"),
    )


#: Of the query's videos: frames a second, width and height of matches with an even and with an odd number.
MIXED_VIDEOS = ((23.976, 1280, 720), (29.97, 640, 200))


def mixed_video_meta(rows: DataFrame) -> DataFrame:
    """Metadata of synthetic matches that were filmed in two sizes and at two rates."""
    odd = F.col("match_id") % 2 == 1
    values = [F.when(odd, F.lit(b)).otherwise(F.lit(a)).alias(c) for c, a, b in zip(("fps", "width", "height"), *MIXED_VIDEOS, strict=True)]
    totals = rows.groupBy("match_id").agg((F.max("frame") + 1).alias("total_frames"))
    return totals.select("match_id", values[0], "total_frames", *values[1:])


#: Names of the metadata's columns beside a match's rows.
FPS, WIDTH, HEIGHT = "video_fps", "video_width", "video_height"


def with_meta(rows: DataFrame, meta: DataFrame | None, config: Tracking = Tracking()) -> DataFrame:
    """The rows with their match's rate and picture size, the configuration's where the match has none or no metadata is given.

    A join by match, which the optimizer makes a broadcast as long as the
    metadata is known to be small; a row a match, of repeated ones the largest.
    """
    values = {FPS: float(config.fps), WIDTH: config.width, HEIGHT: config.height}
    if meta is None:
        return rows.withColumns({c: F.lit(v) for c, v in values.items()})
    one = meta.groupBy("match_id").agg(F.max(F.struct("fps", "width", "height")).alias("m"))
    one = one.select("match_id", F.col("m.fps").cast("double").alias(FPS), F.col("m.width").alias(WIDTH), F.col("m.height").alias(HEIGHT))
    return rows.join(one, "match_id", "left").withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()})


def without_meta(rows: DataFrame) -> DataFrame:
    return rows.drop(FPS, WIDTH, HEIGHT)


def start_frame(fps, config: Tracking = Tracking()):
    return (F.lit(float(config.start_minute)) * 60 * fps).cast("bigint")
