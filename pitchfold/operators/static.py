"""Static objects: a count-based hopping window over the sightings of an id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Tracking


def static_windows(sightings: DataFrame, key: str, config: Tracking = Tracking()) -> DataFrame:
    """(match_id, key, sighting, frame, extent, is_static) at each look: sighting 48 and every 36th after it.

    The window holds the last 48 sightings (not frames); the extent is the
    larger of the two ranges of the center, and static means below the limit.
    """
    order = Window.partitionBy("match_id", key).orderBy("frame", "ord")
    held = order.rowsBetween(-(config.window - 1), 0)
    extent = F.greatest(F.max("cx").over(held) - F.min("cx").over(held), F.max("cy").over(held) - F.min("cy").over(held))
    looks = sightings.withColumns({"sighting": F.row_number().over(order).cast("bigint"), "extent": extent})
    looks = looks.where((F.col("sighting") >= config.window) & ((F.col("sighting") - config.window) % config.hop == 0))
    return looks.select("match_id", key, "sighting", "frame", "extent", (F.col("extent") < config.min_extent).alias("is_static"))


def static_keys(windows: DataFrame, key: str) -> DataFrame:
    """(match_id, key, sighting, frame) of the first static look; later looks of a static object don't count."""
    return windows.where("is_static").groupBy("match_id", key).agg(F.min("sighting").alias("sighting"), F.min("frame").alias("frame"))


def without_static(rows: DataFrame, static: DataFrame, key: str) -> DataFrame:
    """All rows of static objects go, also those before the verdict."""
    return rows.join(static.select("match_id", key), ["match_id", key], "left_anti")
