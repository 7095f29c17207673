"""Two cameras on one match: positions on one plane, the same player seen by both made one.

Positions of a frame meet in cells as wide as the reach, the same or side by
side: an equi-join on (match, frame, cell). What a frame's pairs are is bounded
by the pool of ids, so the one-to-one choice runs inside an aggregate, nearest
pair first, without Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MATRIX = [f"h{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)]


def on_plane(observed: DataFrame, cameras: DataFrame) -> DataFrame:
    """Positions with ``camera_id`` through their camera's plane homography (columns h11 to h33 of ``cameras``, a row a match and camera).

    (match_id, camera_id, frame, id, px, py). Rows of unknown cameras, and
    positions without an image, are left out.
    """
    rows = observed.join(cameras.select("match_id", "camera_id", *_MATRIX), ["match_id", "camera_id"])
    h = lambda i: F.col(f"h{i}1") * F.col("x") + F.col(f"h{i}2") * F.col("y") + F.col(f"h{i}3")
    image = lambda i: F.when(h(3) != 0, h(i) / h(3))
    return rows.select("match_id", "camera_id", "frame", "id", image(1).alias("px"), image(2).alias("py")).where("px IS NOT NULL AND py IS NOT NULL")


def one_to_one(pairs: Column) -> Column:
    """Of an array of (worth, a, b) in order of worth, those whose a and b stand in no pair before them that was taken."""
    kind = "array<struct<a:int,b:int>>"
    free = lambda taken, p: ~F.exists(taken, lambda t: (t["a"] == p["a"]) | (t["b"] == p["b"]))
    return F.aggregate(pairs, F.array().cast(kind), lambda taken, p: F.when(free(taken, p), F.concat(taken, F.array(F.struct(p["a"].alias("a"), p["b"].alias("b"))).cast(kind))).otherwise(taken))


def seen_by_both(first: DataFrame, second: DataFrame, reach: float) -> DataFrame:
    """(match_id, frame, a, b): positions of two cameras that are one player's, at most ``reach`` apart; nearest first, then least ids."""
    cell = lambda c: F.floor(F.col(c) / reach)
    around = lambda c: F.explode(F.array(*[cell(c) + k for k in (-1, 0, 1)]))
    a = first.select("match_id", "frame", F.col("id").alias("a"), "px", "py", around("px").alias("u")).select("*", around("py").alias("v")).alias("l")
    b = second.select("match_id", "frame", F.col("id").alias("b"), "px", "py", cell("px").alias("u"), cell("py").alias("v")).alias("r")
    met = a.join(b, ["match_id", "frame", "u", "v"])
    dx, dy = F.col("l.px") - F.col("r.px"), F.col("l.py") - F.col("r.py")
    near = met.select("match_id", "frame", (dx * dx + dy * dy).alias("d2"), "a", "b").where(F.col("d2") <= reach * reach)
    chosen = near.groupBy("match_id", "frame").agg(one_to_one(F.sort_array(F.collect_list(F.struct("d2", "a", "b")))).alias("pairs"))
    return chosen.select("match_id", "frame", F.inline("pairs"))


def same_ids(pairs: DataFrame, least_frames: int = 1) -> DataFrame:
    """(match_id, a, b): which id of one camera is which of the other, by the number of frames that say so, most first."""
    votes = pairs.groupBy("match_id", "a", "b").agg((-F.count(F.lit(1))).alias("worth")).where(F.col("worth") <= -least_frames)
    return votes.groupBy("match_id").agg(one_to_one(F.sort_array(F.collect_list(F.struct("worth", "a", "b")))).alias("pairs")).select("match_id", F.inline("pairs"))


def merged(first: DataFrame, second: DataFrame, reach: float, players: int) -> DataFrame:
    """One table of both cameras' positions: (match_id, frame, person, a, b, px, py), a player once a frame.

    Players seen by both stand in the middle. ``person`` is the first camera's
    id; what only the second sees takes the id that stands for it in most frames
    of the match, unless the first sees that id elsewhere in the frame, or else
    its own id above ``players``. Ids must be unique in a camera's frame.
    """
    pairs = seen_by_both(first, second, reach)
    a = first.select("match_id", "frame", F.col("id").alias("a"), F.col("px").alias("ax"), F.col("py").alias("ay"))
    b = second.select("match_id", "frame", F.col("id").alias("b"), F.col("px").alias("bx"), F.col("py").alias("by"))
    left = a.join(pairs, ["match_id", "frame", "a"], "left")
    known = left.where("b IS NOT NULL").join(b, ["match_id", "frame", "b"]).select("match_id", "frame", "a", "b", ((F.col("ax") + F.col("bx")) / 2).alias("px"), ((F.col("ay") + F.col("by")) / 2).alias("py"))
    only_a = left.where("b IS NULL").select("match_id", "frame", "a", "b", F.col("ax").alias("px"), F.col("ay").alias("py"))
    rest = b.join(pairs, ["match_id", "frame", "b"], "left_anti")
    named = rest.join(same_ids(pairs).withColumnRenamed("a", "same"), ["match_id", "b"], "left")
    there = a.select("match_id", "frame", F.col("a").alias("same"), F.lit(True).alias("there"))
    named = named.join(there, ["match_id", "frame", "same"], "left")
    own = F.when(F.col("there").isNull() & F.col("same").isNotNull(), F.col("same")).otherwise(F.col("b") + players)
    only_b = named.select("match_id", "frame", own.cast("int").alias("person"), F.lit(None).cast("int").alias("a"), "b", F.col("bx").alias("px"), F.col("by").alias("py"))
    seen = known.unionByName(only_a).select("match_id", "frame", F.col("a").alias("person"), "a", "b", "px", "py")
    return seen.unionByName(only_b)
