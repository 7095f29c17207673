"""Extensions that the roadmap names: heat maps, distance and speed, metres from pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Tracking
from ..sources.tables import FPS, with_meta


def heatmap(observed: DataFrame, cell: int = 40) -> DataFrame:
    """(match_id, id, cell_x, cell_y, n)."""
    at = [F.floor(F.col(c) / cell).alias(f"cell_{c}") for c in ("x", "y")]
    return observed.groupBy("match_id", "id", *at).agg(F.count(F.lit(1)).alias("n"))


def distance_speed(observed: DataFrame, config: Tracking = Tracking(), meta: DataFrame | None = None) -> DataFrame:
    """(match_id, id, distance, top_speed) in pixels and pixels a second, from sighting to sighting, at each match's rate."""
    observed = with_meta(observed, meta, config)
    order = Window.partitionBy("match_id", "id").orderBy("frame")
    dx, dy = (F.col(c) - F.lag(c).over(order) for c in ("x", "y"))
    steps = observed.withColumns({"d": F.sqrt((dx * dx + dy * dy).cast("double")), "frames": F.col("frame") - F.lag("frame").over(order)})
    return steps.groupBy("match_id", "id").agg(F.round(F.coalesce(F.sum("d"), F.lit(0.0)), 6).alias("distance"), F.round(F.max(F.col("d") * F.col(FPS) / F.col("frames")), 6).alias("top_speed"))


def to_field(observed: DataFrame, h: tuple[tuple[float, float, float], ...]) -> DataFrame:
    """Positions through a plane homography: (match_id, frame, id, field_x, field_y); null where it has no image."""
    row = [F.col("x") * a + F.col("y") * b + c for a, b, c in h]
    image = lambda v: F.round(F.when(row[2] != 0, v / row[2]), 6)
    return observed.select("match_id", "frame", "id", image(row[0]).alias("field_x"), image(row[1]).alias("field_y"))
