"""Box geometry as Column expressions, and the same as temporary SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..config import Tracking

CORNERS = ("x1", "y1", "x2", "y2")


def box(prefix: str = "") -> list[Column]:
    """The four corners, of the alias ``prefix`` if given."""
    return [F.col(f"{prefix}.{c}" if prefix else c) for c in CORNERS]


def truncated(column: str) -> Column:
    """Toward zero, as a whole number."""
    return F.col(column).cast("bigint")


def center(low: Column, high: Column) -> Column:
    """Middle of two whole numbers, rounded down also below zero."""
    return F.floor((low + high) / 2)


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union; 0.0 without a positive overlap or union."""
    wide = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    high = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    inter = F.greatest(wide, F.lit(0)) * F.greatest(high, F.lit(0))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(F.lit(0.0))


def squared_distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return (ax - bx) * (ax - bx) + (ay - by) * (ay - by)


def valid_player_box(config: Tracking = Tracking(), corners: list[Column] | None = None, size: tuple[Column, Column] | None = None) -> Column:
    """Inside the margins and of a plausible shape; the shape is compared in single precision, bounds included.

    ``size`` is the picture's width and height, the configuration's if not given.
    """
    width, height = size or (F.lit(config.width), F.lit(config.height))
    x1, y1, x2, y2 = corners or box()
    shape = (F.greatest(y2 - y1, F.lit(1)) / F.greatest(x2 - x1, F.lit(1))).cast("float")
    low, high = (F.lit(r).cast("float") for r in (config.ratio_min, config.ratio_max))
    outside = (x1 < config.margin_side) & (x2 < config.margin_side)
    return (y1 >= config.margin_top) & ~outside & (x1 <= width - config.margin_side) & (y1 <= height - config.margin_bottom) & shape.between(low, high)


def register(spark: SparkSession, config: Tracking = Tracking()) -> None:
    """Temporary SQL functions: box_iou, box_center, px_distance, valid_player_box. No Python runs in them."""
    corners = [f"{p}{c} BIGINT" for p in "ab" for c in CORNERS]
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION box_iou({', '.join(corners)}) RETURNS DOUBLE RETURN
        (SELECT CASE WHEN i > 0 AND u - i > 0 THEN i / (u - i) ELSE 0D END FROM
        (SELECT greatest(least(ax2, bx2) - greatest(ax1, bx1), 0) * greatest(least(ay2, by2) - greatest(ay1, by1), 0) AS i,
                (ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) AS u))""")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION box_center(a BIGINT, b BIGINT) RETURNS BIGINT RETURN floor((a + b) / 2)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION px_distance(ax BIGINT, ay BIGINT, bx BIGINT, by_ BIGINT) RETURNS DOUBLE RETURN sqrt((ax - bx) * (ax - bx) + (ay - by_) * (ay - by_))")
    c = config
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION valid_player_box(x1 BIGINT, y1 BIGINT, x2 BIGINT, y2 BIGINT) RETURNS BOOLEAN RETURN
        y1 >= {c.margin_top} AND NOT (x1 < {c.margin_side} AND x2 < {c.margin_side}) AND x1 <= {c.width - c.margin_side} AND y1 <= {c.height - c.margin_bottom}
        AND CAST(greatest(y2 - y1, 1) / greatest(x2 - x1, 1) AS FLOAT) BETWEEN CAST({c.ratio_min} AS FLOAT) AND CAST({c.ratio_max} AS FLOAT)""")
