"""Drawing commands as rows, colours, and files."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..config import Tracking
from .identity import EXPORTED, OCCLUDED, observations

#: Colour of each id, three channels.
PALETTE = {
    1: (147, 76, 186),
    2: (78, 84, 141),
    3: (225, 151, 192),
    4: (216, 77, 195),
    5: (240, 181, 211),
    6: (233, 184, 167),
    7: (206, 120, 197),
    8: (91, 210, 167),
    9: (109, 174, 100),
    10: (184, 153, 61),
    11: (175, 161, 95),
    12: (235, 201, 251),
    13: (238, 179, 248),
}
RAW_COLOUR, BALL_COLOUR, DIMMED = (0, 220, 0), (0, 255, 255), 80
#: Fixed values of each kind of drawing: line width; label's scale, line width, offset from the box's corner and colour;
#: how much wider and higher than its text the label's field is (none if 0); radius of the dot at the center (none if 0).
STYLES = {
    "raw": (1, 0.0, 0, 0, 0, "", 0, 0, 0),
    "player": (3, 0.75, 2, 2, -3, "0,0,0", 4, 8, 5),
    "occluded": (2, 0.65, 1, 2, -2, "255,255,255", 4, 6, 0),
    "ball": (3, 0.65, 2, 0, -5, "0,255,255", 0, 0, 6),
}
HUD_PLACE, HUD_COLOUR = (10, 35), (0, 255, 0)
#: The display's line, the console's line, and how they say whether there is a ball.
HUD_LINE = "Min:%s | Dets:%s/%s | IDs:%s/%s | Activos:%s | Pelota:%s"
PROGRESS_LINE = "  Min %s | IDs:%s/%s | Activos:%s | Estáticos:%s | Pelota:%s"
YES, NO = "SI", "NO"
#: The console's lines on ids that begin, are found again, and are static.
NEW_LINE = "  [NUEVO] ByteID:%s → ID:%s (pool restante:%s)"
REID_LINE = "  [REID] ByteID:%s → ID:%s (dist=%spx)"
STATIC_LINE = "  [ESTÁTICO] ID:%s descartado, slot devuelto"
#: The lines of the final summary, with the column of the run's summary that each tells.
SUMMARY_LINES = (
    ("Frames procesados:         %s", "frames"),
    ("Detecciones totales:       %s", "dets_raw"),
    ("Frames sin tracks:         %s", "frames_without_tracks"),
    ("IDs estáticos descartados: %s", "static"),
    ("IDs únicos jugadores: %s", "player_ids"),
    ("Registros jugadores:  %s", "player_rows"),
    ("Frames con pelota detectada: %s", "ball_frames"),
)


def palette(spark: SparkSession) -> DataFrame:
    """(id, c1, c2, c3) and the dimmed colour (d1, d2, d3) of hidden players."""
    rows = spark.createDataFrame([(i, *c) for i, c in PALETTE.items()], "id int, c1 int, c2 int, c3 int")
    return rows.select("*", *[F.greatest(F.col(f"c{k}") - DIMMED, F.lit(0)).alias(f"d{k}") for k in (1, 2, 3)])


def colours_of(observed: DataFrame) -> DataFrame:
    """(match_id, id, c1, c2, c3, d1, d2, d3): colours of the ids that a match shows."""
    return observed.select("match_id", "id").distinct().join(F.broadcast(palette(observed.sparkSession)), "id")


def _rows(frame: DataFrame, kind: str, label: Column, colour: Column) -> DataFrame:
    return frame.select("match_id", "frame", F.lit(kind).alias("kind"), "x1", "y1", "x2", "y2", label.alias("label"), colour.alias("colour"))


def _drawn(rows: DataFrame) -> DataFrame:
    """Rows with how they are drawn; a point or field that a kind lacks is null."""
    k = lambda n: F.coalesce(*[F.when(F.col("kind") == kind, F.lit(style[n])) for kind, style in STYLES.items()])
    labelled, dotted, field = F.col("label") != "", k(8) > 0, k(6) > 0
    middle = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2)
    return rows.select(
        "*",
        k(0).alias("line_width"),
        F.when(labelled, F.col("x1") + k(3)).alias("label_x"),
        F.when(labelled, F.col("y1") + k(4)).alias("label_y"),
        F.when(labelled, k(1)).alias("label_scale"),
        F.when(labelled, k(2)).alias("label_width"),
        F.when(labelled, k(5)).alias("label_colour"),
        F.when(field, k(6)).alias("field_wider"),
        F.when(field, k(7)).alias("field_higher"),
        F.when(dotted, middle("x1", "x2")).alias("dot_x"),
        F.when(dotted, middle("y1", "y2")).alias("dot_y"),
        F.when(dotted, k(8)).alias("dot_radius"),
    )


def annotations(valid_players: DataFrame, balls: DataFrame, log: DataFrame) -> DataFrame:
    """(match_id, frame, kind, corners, label, colour) and how it is drawn: raw, player, occluded and ball boxes.

    A label's text stands at (label_x, label_y), its lower left corner. Behind it
    lies a field of the box's colour on the box's upper left corner, wider and
    higher than the text by the given pixels. A dot marks the center.
    """
    colours = F.broadcast(palette(log.sparkSession))  # one row an id of the pool
    named = log.where(F.col("status").isin(EXPORTED, OCCLUDED)).join(colours, "id")
    text = lambda p: F.concat_ws(",", *[F.col(f"{p}{k}") for k in (1, 2, 3)])
    fixed = lambda c: F.lit(",".join(map(str, c)))
    hidden = F.col("status") == OCCLUDED
    players = named.select(
        "match_id",
        "frame",
        F.when(hidden, "occluded").otherwise("player").alias("kind"),
        "x1",
        "y1",
        "x2",
        "y2",
        F.concat(F.lit("ID:"), F.col("id").cast("string"), F.when(hidden, "~").otherwise("")).alias("label"),
        F.when(hidden, text("d")).otherwise(text("c")).alias("colour"),
    )
    raw = _rows(valid_players, "raw", F.lit(""), fixed(RAW_COLOUR))
    ball = _rows(balls, "ball", F.lit("PELOTA"), fixed(BALL_COLOUR))
    return _drawn(raw.unionByName(players).unionByName(ball))


def write_csv(rows: DataFrame, path: str, order: list[str], one_file: bool = False) -> bool:
    """Write with a header in a fixed order; False and no file if there are no rows.

    Booleans are written as True and False. ``one_file`` gathers everything in
    one task, for reports that are known to be small.
    """
    if rows.isEmpty():
        return False
    for name, kind in rows.dtypes:
        if kind == "boolean":
            rows = rows.withColumn(name, F.when(F.col(name), "True").when(~F.col(name), "False"))
    rows = rows.coalesce(1).sortWithinPartitions(*order) if one_file else rows.orderBy(*order)
    rows.write.mode("overwrite").option("header", True).csv(path)
    return True


def write_players(log: DataFrame, path: str, one_file: bool = False, emit_occluded: bool = False) -> bool:
    """Players' positions; a header alone if static removal leaves none, no file if there was never a row.

    The log is stored first, in ``path`` with ``-log`` at its end, and everything
    is made from there, so the fold runs once.
    """
    log.write.mode("overwrite").parquet(f"{path}-log")
    log = log.sparkSession.read.schema(log.schema).parquet(f"{path}-log")
    if log.where(F.col("status") == EXPORTED).isEmpty():
        return False
    observed = observations(log, emit_occluded)
    if not write_csv(observed, path, ["match_id", "frame", "id"], one_file):
        observed.limit(0).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return True


def write_ball(balls: DataFrame, path: str, one_file: bool = False) -> bool:
    """The ball's position in each frame that has one: (match_id, frame, x, y). Without any, a warning and no file."""
    if write_csv(balls.select(*schemas.BALL_OBSERVATIONS), path, ["match_id", "frame"], one_file):
        return True
    warnings.warn("the ball was not detected in any frame: no file is written", stacklevel=2)
    return False


def _line(form: str, *values: Column | str) -> Column:
    return F.format_string(form, *[F.col(v).cast("string") if isinstance(v, str) else v for v in values])


def hud(metrics: DataFrame, config: Tracking = Tracking()) -> DataFrame:
    """(match_id, frame, x, y, label, colour): the line of figures on each frame of ``metrics.frame_metrics``."""
    label = _line(HUD_LINE, _minute(), "n_dets", "n_dets_raw", "ids_assigned", F.lit(str(config.players)), "n_active", _yes("ball_detected"))
    return metrics.select("match_id", "frame", F.lit(HUD_PLACE[0]).alias("x"), F.lit(HUD_PLACE[1]).alias("y"), label.alias("label"), F.lit(",".join(map(str, HUD_COLOUR))).alias("colour"))


def progress_lines(progress: DataFrame, config: Tracking = Tracking()) -> DataFrame:
    """(match_id, frame, line): what the console says at each frame of ``metrics.progress``."""
    line = _line(PROGRESS_LINE, _minute(), "ids_assigned", F.lit(str(config.players)), "n_active", "n_static", _yes("ball_detected"))
    return progress.select("match_id", "frame", line.alias("line"))


def event_lines(events: DataFrame) -> DataFrame:
    """(match_id, frame, ord, line): what the console says at each of ``identity.events``."""
    new = _line(NEW_LINE, "tid", "id", "pool")
    found = _line(REID_LINE, "tid", "id", F.format_string("%.0f", "distance"))
    line = F.when(F.col("event") == "static", _line(STATIC_LINE, "id")).when(F.col("event") == "reid", found).otherwise(new)
    return events.select("match_id", "frame", "ord", line.alias("line"))


def summary_lines(summary: DataFrame) -> DataFrame:
    """(match_id, nth, line): the final summary of each match, from ``metrics.run_summary``; players and ball only if there are any."""
    told = summary.withColumn("static", F.concat(F.col("static_ids").cast("string"), F.lit(" → ["), F.replace("static_list", F.lit(","), F.lit(", ")), F.lit("]")))
    lines = [_line(form, column) for form, column in SUMMARY_LINES]
    lines[4:6] = [F.when(F.col("player_rows") > 0, line) for line in lines[4:6]]
    lines[6] = F.when(F.col("ball_frames") > 0, lines[6])
    return told.select("match_id", F.posexplode(F.array(*lines)).alias("nth", "line")).where("line IS NOT NULL")


def _minute() -> Column:
    """One decimal, halves to even."""
    return F.format_string("%.1f", F.bround("minute", 1))


def _yes(flag: str) -> Column:
    return F.when(F.col(flag), F.lit(YES)).otherwise(NO)
