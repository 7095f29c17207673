"""Tracks out of detections: constant-velocity filters and a linear assignment in rounds of confidence.

After the published method of associating every detection box (ECCV 2022):
confident boxes are matched first with all tracks, faint ones with the tracks
that are left, and what remains begins tracks. A track is followed by a Kalman
filter over center, shape and height of its box. With the usual noise, whose
covariances are diagonal, that filter falls apart into one of position and
velocity for each of the four, so a match's state is one small matrix.

The fold is sequential within a match, so rows are dealt out by match, sorted by
(frame, ord), and stream through; a task holds one frame and the tracks alive.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..config import BALL_TRACKS, PLAYER_TRACKS, Association, Tracking
from ..functions.geometry import CORNERS, truncated
from ..sources.tables import by_match
from .detections import source_filter, split, valid_players

#: Noise of positions and velocities in heights of the box; the shape has noise of its own.
POSITION, VELOCITY = 1 / 20, 1 / 160
SHAPE_NOISE, SHAPE_DRIFT, SHAPE_MEASURED = 1e-2, 1e-5, 1e-1
SHAPE, HEIGHT = 2, 3
#: Columns of the state: value, velocity, and their variances and covariance, for each of center x, y, shape, height.
X, V, XX, XV, VV = (slice(4 * k, 4 * k + 4) for k in range(5))
WIDTH = 20


def _measure(boxes: np.ndarray) -> np.ndarray:
    """Center x, y, width by height, height."""
    w, h = boxes[:, 2] - boxes[:, 0], boxes[:, 3] - boxes[:, 1]
    return np.stack([boxes[:, 0] + w / 2, boxes[:, 1] + h / 2, w / h, h], axis=1)


def _corners(s: np.ndarray) -> np.ndarray:
    h = s[:, HEIGHT]
    w = s[:, SHAPE] * h
    return np.stack([s[:, 0] - w / 2, s[:, 1] - h / 2, s[:, 0] + w / 2, s[:, 1] + h / 2], axis=1)


def _noise(heights: np.ndarray, by_height: float, shape: float) -> np.ndarray:
    """Variances of the four, from deviations."""
    out = np.repeat((by_height * heights)[:, None], 4, axis=1)
    out[:, SHAPE] = shape
    return out * out


def begun(boxes: np.ndarray) -> np.ndarray:
    """States of tracks that begin with these boxes."""
    z = _measure(boxes)
    s = np.zeros((len(z), WIDTH))
    s[:, X] = z
    s[:, XX] = _noise(z[:, HEIGHT], 2 * POSITION, SHAPE_NOISE)
    s[:, VV] = _noise(z[:, HEIGHT], 10 * VELOCITY, SHAPE_DRIFT)
    return s


def predicted(s: np.ndarray, lost: np.ndarray) -> np.ndarray:
    """States one frame later; the height of lost tracks stays."""
    s = s.copy()
    s[lost, V.start + HEIGHT] = 0
    h = s[:, HEIGHT].copy()
    s[:, X] += s[:, V]
    s[:, XX] += 2 * s[:, XV] + s[:, VV] + _noise(h, POSITION, SHAPE_NOISE)
    s[:, XV] += s[:, VV]
    s[:, VV] += _noise(h, VELOCITY, SHAPE_DRIFT)
    return s


def corrected(s: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """States after the boxes that were matched with them."""
    s = s.copy()
    total = s[:, XX] + _noise(s[:, HEIGHT], POSITION, SHAPE_MEASURED)
    gain, drift = s[:, XX] / total, s[:, XV] / total
    off = _measure(boxes) - s[:, X]
    s[:, X] += gain * off
    s[:, V] += drift * off
    s[:, VV] -= drift * s[:, XV]
    s[:, XV] -= gain * s[:, XV]
    s[:, XX] -= gain * s[:, XX]
    return s


def overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of each of a with each of b."""
    wide = np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0])
    high = np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1])
    inter = np.maximum(wide, 0) * np.maximum(high, 0)
    area = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    union = area(a)[:, None] + area(b)[None, :] - inter
    return np.divide(inter, union, out=np.zeros_like(inter), where=(inter > 0) & (union > 0))


def _shortest(gain: np.ndarray) -> list[tuple[int, int]]:
    """Assignment of least sum, each row to a column of its own (rows are not more than columns): shortest augmenting paths."""
    n, m = gain.shape
    row_price, price = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, int)  # of a column: its row, from 1; 0 is none
    for i in range(1, n + 1):
        owner[0], j = i, 0
        least, back, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[j] = True
            slack = gain[owner[j] - 1] - row_price[owner[j]] - price[1:]
            closer = ~used[1:] & (slack < least[1:])
            least[1:][closer], back[1:][closer] = slack[closer], j
            to = int(np.where(used, np.inf, least).argmin())
            step = least[to]
            row_price[owner[used]] += step
            price[used] -= step
            least[~used] -= step
            j = to
            if owner[j] == 0:
                break
        while j:
            owner[j], j = owner[back[j]], back[j]
    return [(int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j]]


def assign(cost: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost, where a row or column without a partner costs half the limit.

    So no pair costs the limit or more. Rows and columns that no such pair links
    are apart, and each linked set is solved for itself.
    """
    near = cost < limit
    alone = near & (near.sum(axis=1) == 1)[:, None] & (near.sum(axis=0) == 1)
    pairs, seen = list(zip(*(k.tolist() for k in np.nonzero(alone)), strict=True)), alone.any(axis=1)
    for start in np.flatnonzero(near.any(axis=1) & ~seen).tolist():
        if seen[start]:
            continue
        rows = np.zeros(len(cost), bool)
        rows[start] = True
        while True:
            columns = near[rows].any(axis=0)
            wider = near[:, columns].any(axis=1)
            if (wider == rows).all():
                break
            rows = wider
        seen |= rows
        r, c = np.flatnonzero(rows), np.flatnonzero(columns)
        gain = np.minimum(cost[np.ix_(r, c)] - limit, 0)
        found = _shortest(gain) if len(r) <= len(c) else [(i, j) for j, i in _shortest(gain.T)]
        pairs += [(int(r[i]), int(c[j])) for i, j in found if gain[i, j] < 0]
    return sorted(pairs)


class Tracks:
    """The tracks of one match. Feed frames in order; frames between them count as empty."""

    def __init__(self, config: Association = PLAYER_TRACKS):
        self.config = config
        self.frame: int | None = None
        self.next = 1
        self.tid, self.born, self.last = (np.zeros(0, np.int64) for _ in range(3))
        self.sure = np.zeros(0, bool)
        self.state = np.zeros((0, WIDTH))

    def _keep(self, which: np.ndarray) -> None:
        self.tid, self.born, self.last, self.sure, self.state = (x[which] for x in (self.tid, self.born, self.last, self.sure, self.state))

    def _match(self, tracks: np.ndarray, boxes: np.ndarray, every: np.ndarray, conf: np.ndarray | None, limit: float) -> list[tuple[int, int]]:
        """Pairs (track, box) among the given ones; with ``conf``, a box counts for less the fainter it is."""
        if not len(tracks) or not len(boxes):
            return []
        like = overlap(_corners(self.state[tracks]), every[boxes])
        cost = 1 - like * conf[boxes] if conf is not None else 1 - like
        return [(int(tracks[i]), int(boxes[j])) for i, j in assign(cost, limit)]

    def pass_to(self, frame: int) -> None:
        """Empty frames up to this one: unsure tracks go at once, lost ones at the end of their life."""
        while self.frame is not None and self.frame < frame - 1 and len(self.tid):
            self.step(self.frame + 1, np.zeros((0, 4)), np.zeros(0))
        if self.frame is not None:
            self.frame = max(self.frame, frame - 1)

    def step(self, frame: int, boxes: np.ndarray, conf: np.ndarray) -> list[tuple]:
        """(tid, corners, conf, box) of the tracks that are seen in the frame, by tid; ``box`` is the row of the matched box."""
        c, first = self.config, self.frame is None
        if not first and frame > self.frame + 1:
            self.pass_to(frame)
        self.frame = frame
        lost = self.last < frame - 1
        self.state = predicted(self.state, lost)
        high = np.flatnonzero(conf >= c.threshold)
        pairs = self._match(np.flatnonzero(self.sure), high, boxes, conf, c.match)
        met = {t for t, _ in pairs}
        left = np.array([t for t in np.flatnonzero(self.sure & ~lost) if t not in met], int)
        pairs += self._match(left, np.flatnonzero((conf > c.low) & (conf < c.threshold)), boxes, None, c.match_low)
        taken = {b for _, b in pairs}
        high = np.array([b for b in high if b not in taken], int)
        pairs += self._match(np.flatnonzero(~self.sure), high, boxes, conf, c.match_new)
        of = {t: b for t, b in pairs}
        if of:
            t, b = np.array(list(of)), np.array(list(of.values()))
            self.state[t] = corrected(self.state[t], boxes[b])
            self.last[t], self.sure[t] = frame, True
        seen = {int(self.tid[t]): b for t, b in of.items()}
        self._keep(self.sure & (frame - self.last <= c.buffer))
        self._without_doubles(frame)
        new = np.array([b for b in high if b not in set(of.values()) and conf[b] >= (c.threshold if c.begin is None else c.begin)], int)
        if len(new):
            ids = np.arange(self.next, self.next + len(new))
            self.next += len(new)
            seen |= dict(zip(ids.tolist(), new.tolist(), strict=True))
            now = np.full(len(new), frame)
            self.tid, self.born, self.last = (np.concatenate(x) for x in ((self.tid, ids), (self.born, now), (self.last, now)))
            self.sure = np.concatenate([self.sure, np.full(len(new), first)])
            self.state = np.concatenate([self.state, begun(boxes[new])])
        shown = np.flatnonzero(self.sure & (self.last == frame))
        corners = _corners(self.state[shown])
        return [(tid, *box, float(conf[seen[tid]]), seen[tid]) for tid, box in zip(self.tid[shown].tolist(), corners.tolist(), strict=True)]

    def _without_doubles(self, frame: int) -> None:
        """A lost track on the place of a seen one: the one that lived longer stays."""
        now, then = np.flatnonzero(self.last == frame), np.flatnonzero(self.last < frame)
        if not len(now) or not len(then):
            return
        close = 1 - overlap(_corners(self.state[now]), _corners(self.state[then])) < self.config.same
        keep = np.ones(len(self.tid), bool)
        for i, j in zip(*np.nonzero(close), strict=True):
            a, b = now[i], then[j]
            keep[b if self.last[a] - self.born[a] > self.last[b] - self.born[b] else a] = False
        self._keep(keep)


Row = tuple[int, float, float, float, float, float]
_IN = ("match_id", "frame", "ord", *CORNERS, "conf")
_OUT = [c.split()[0] for c in schemas.ASSOCIATED.split(", ")]


def folded(match: int, frame: int, tracks: Tracks, rows: Iterable[Row]) -> list[tuple]:
    """The tracks of one frame from its rows (ord, corners, conf), as rows of the result."""
    rows = sorted(rows)
    data = np.array(rows, float).reshape(len(rows), 6)
    return [(match, frame, k, tid, *box, conf, rows[b][0]) for k, (tid, *box, conf, b) in enumerate(tracks.step(frame, data[:, 1:5], data[:, 5]))]


def associate(detections: DataFrame, config: Association = PLAYER_TRACKS) -> DataFrame:
    """Tracks of the detections of a class: match_id, frame, ord, tid, filtered corners, conf, det_ord (the matched box).

    A track is seen from its second frame on, or from the first frame of the
    match. ``ord`` is the place in order of track ids, which begin at 1 in each
    match. Boxes without an area, with a missing or a non-finite value are left
    out. Equal boxes are in order of ``ord``. An empty table gives an empty
    result; other columns are ignored.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        match, frame, tracks, rows = None, None, Tracks(config), []
        for part in frames:
            out: list[tuple] = []
            for own, at, *row in part[list(_IN)].itertuples(index=False, name=None):
                if (own, at) != (match, frame):
                    if rows:
                        out += folded(match, frame, tracks, rows)
                    if own != match:
                        tracks = Tracks(config)
                    match, frame, rows = own, at, []
                rows.append(tuple(row))
            yield pd.DataFrame(out, columns=_OUT)
        if rows:
            yield pd.DataFrame(folded(match, frame, tracks, rows), columns=_OUT)

    ordered = by_match(sound_boxes(detections)).sortWithinPartitions("match_id", "frame", "ord")
    return ordered.mapInPandas(run, schemas.ASSOCIATED)


def sound_boxes(detections: DataFrame, *more: str) -> DataFrame:
    """(match_id, frame, ord, corners, conf) of the boxes that have an area, and ``more`` columns; corners and conf as doubles."""
    rows = detections.select(*more, "match_id", "frame", F.col("ord").cast("bigint").alias("ord"), *[F.col(c).cast("double").alias(c) for c in (*CORNERS, "conf")])
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) for c in (*CORNERS, "conf")]
    for ok in (*finite, F.col("x2") > F.col("x1"), F.col("y2") > F.col("y1"), F.col("match_id").isNotNull() & F.col("frame").isNotNull() & F.col("ord").isNotNull()):
        rows = rows.where(ok)
    return rows


def player_tracks(detections: DataFrame, tracking: Tracking = Tracking(), config: Association = PLAYER_TRACKS, meta: DataFrame | None = None) -> DataFrame:
    """Players' tracks for the identity fold, from detections alone: corners as whole numbers."""
    found = associate(valid_players(detections, tracking, meta), config)
    return found.select("match_id", "frame", "ord", "tid", *[truncated(c).alias(c) for c in CORNERS])


def ball_tracks(detections: DataFrame, tracking: Tracking = Tracking(), config: Association = BALL_TRACKS) -> DataFrame:
    """Balls' tracks, of which ``ball.best_ball`` takes the most confident in each frame."""
    return associate(split(source_filter(detections, tracking))[1], config).select("match_id", "frame", "ord", "tid", *CORNERS, "conf")
