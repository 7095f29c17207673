"""Association against a plain tracker: full filter matrices and assignment by trying all."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pitchfold.config import BALL_TRACKS, PLAYER_TRACKS, Association
from pitchfold.operators import association, ball, detections, identity
from pitchfold.operators.association import Tracks, assign, associate
from pitchfold.plans import queries
from pitchfold.sources import tables

DETECTIONS = "match_id bigint, frame bigint, ord bigint, x1 double, y1 double, x2 double, y2 double, conf double, cls int"
SF = "/root/testdata/sf0.001"


def best_by_trying(cost, limit):
    """Least total and its pairs over all ways to pair rows and columns."""
    n, m = len(cost), len(cost[0]) if len(cost) else 0
    best = (limit / 2 * (n + m), [])
    for k in range(1, min(n, m) + 1):
        for rows in itertools.combinations(range(n), k):
            for columns in itertools.permutations(range(m), k):
                if all(cost[i][j] < limit for i, j in zip(rows, columns)):
                    total = sum(cost[i][j] for i, j in zip(rows, columns)) + limit / 2 * (n + m - 2 * k)
                    best = min(best, (total, list(zip(rows, columns))), key=lambda b: b[0])
    return best


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.floats(0.1, 1.0), st.integers(0, 10**6))
def test_assignment_is_the_best_of_all(n, m, limit, seed):
    cost = np.random.default_rng(seed).random((n, m))
    pairs = assign(cost, limit)
    total, expected = best_by_trying(cost.tolist(), limit)
    assert pairs == sorted(expected)
    assert sum(cost[i, j] for i, j in pairs) + limit / 2 * (n + m - 2 * len(pairs)) == pytest.approx(total)


def test_seven_boxes_against_all_permutations():
    rng = np.random.default_rng(7)
    for _ in range(4):
        cost = rng.random((7, 7))
        total = min(sum(cost[i, p[i]] for i in range(7)) for p in itertools.permutations(range(7)))
        assert sum(cost[i, j] for i, j in assign(cost, 100.0)) == pytest.approx(total)  # all are paired below so high a limit


def test_equal_costs_pair_all():
    assert len(assign(np.zeros((5, 5)), 0.9)) == 5 and assign(np.ones((3, 2)), 0.9) == []


class PlainTracker:
    """The same rules with 8x8 matrices, a dict a track, and assignment by trying all."""

    def __init__(self, config):
        self.c, self.tracks, self.next, self.frame = config, [], 1, None

    @staticmethod
    def z(b):
        return np.array([(b[0] + b[2]) / 2, (b[1] + b[3]) / 2, (b[2] - b[0]) / (b[3] - b[1]), b[3] - b[1]])

    @staticmethod
    def box(t):
        x, y, a, h = t["m"][:4]
        return (x - a * h / 2, y - h / 2, x + a * h / 2, y + h / 2)

    @staticmethod
    def iou(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        inter = max(w, 0) * max(h, 0)
        union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
        return inter / union if inter > 0 and union > 0 else 0.0

    def pair(self, tracks, boxes, limit, fused):
        if not tracks or not boxes:
            return []
        cost = [[1 - self.iou(self.box(t), b[:4]) * (b[4] if fused else 1) for b in boxes] for t in tracks]
        return [(tracks[i], boxes[j]) for i, j in best_by_trying(cost, limit)[1]]

    def one(self, frame, boxes):
        c, first = self.c, self.frame is None
        self.frame = frame
        for t in self.tracks:
            if t["last"] < frame - 1:
                t["m"][7] = 0
            h = t["m"][3]
            F = np.eye(8) + np.eye(8, k=4)
            q = np.diag(np.array([h / 20, h / 20, 1e-2, h / 20, h / 160, h / 160, 1e-5, h / 160]) ** 2)
            t["m"], t["P"] = F @ t["m"], F @ t["P"] @ F.T + q
        high = [b for b in boxes if b[4] >= c.threshold]
        met = self.pair([t for t in self.tracks if t["sure"]], high, c.match, True)
        rest = [t for t in self.tracks if t["sure"] and t["last"] == frame - 1 and not any(t is u for u, _ in met)]
        met += self.pair(rest, [b for b in boxes if c.low < b[4] < c.threshold], c.match_low, False)
        high = [b for b in high if not any(b is x for _, x in met)]
        met += self.pair([t for t in self.tracks if not t["sure"]], high, c.match_new, True)
        for t, b in met:
            h = t["m"][3]
            H, R = np.eye(4, 8), np.diag(np.array([h / 20, h / 20, 1e-1, h / 20]) ** 2)
            K = t["P"] @ H.T @ np.linalg.inv(H @ t["P"] @ H.T + R)
            t["m"], t["P"] = t["m"] + K @ (self.z(b) - H @ t["m"]), (np.eye(8) - K @ H) @ t["P"]
            t.update(last=frame, sure=True, conf=b[4])
        self.tracks = [t for t in self.tracks if t["sure"] and frame - t["last"] <= c.buffer]
        gone = []
        for a in self.tracks:
            for b in self.tracks:
                if a["last"] == frame and b["last"] < frame and 1 - self.iou(self.box(a), self.box(b)) < c.same:
                    gone.append(id(b) if a["last"] - a["born"] > b["last"] - b["born"] else id(a))
        self.tracks = [t for t in self.tracks if id(t) not in gone]
        for b in high:
            if not any(b is x for _, x in met) and b[4] >= (c.threshold if c.begin is None else c.begin):
                h = b[3] - b[1]
                P = np.diag(np.array([h / 10, h / 10, 1e-2, h / 10, h / 16, h / 16, 1e-5, h / 16]) ** 2)
                self.tracks.append({"tid": self.next, "m": np.r_[self.z(b), np.zeros(4)], "P": P, "born": frame, "last": frame, "sure": first, "conf": b[4]})
                self.next += 1
        return [(t["tid"], *self.box(t), t["conf"]) for t in self.tracks if t["sure"] and t["last"] == frame]

    def step(self, frame, boxes):
        while self.frame is not None and self.frame < frame - 1:
            self.one(self.frame + 1, [])
        return self.one(frame, boxes)


def walk(seed: int, frames: int = 60, players: int = 6) -> dict[int, list[tuple]]:
    """Players that walk, cross, hide for a while and are seen faintly at times."""
    rng = random.Random(seed)
    where = [[rng.uniform(50, 400), rng.uniform(60, 250), rng.uniform(-4, 4), rng.uniform(-2, 2)] for _ in range(players)]
    out = {}
    for frame in range(100, 100 + frames):
        rows = []
        for p in where:
            p[0], p[1] = p[0] + p[2], p[1] + p[3]
            if rng.random() < 0.8 and not (frame % 29 < 3):
                x, y = p[0] + rng.uniform(-2, 2), p[1] + rng.uniform(-2, 2)
                rows.append((x, y, x + 30 + rng.uniform(-1, 1), y + 60 + rng.uniform(-1, 1), round(rng.uniform(0.05, 0.99), 3)))
        out[frame] = rows
    return out


@pytest.mark.parametrize("config", [PLAYER_TRACKS, BALL_TRACKS, Association(threshold=0.6, match=0.8, buffer=5), Association(threshold=0.5, begin=0.7, match_new=0.4, buffer=10)])
@pytest.mark.parametrize("seed", range(4))
def test_against_a_plain_tracker(config, seed):
    ours, plain = Tracks(config), PlainTracker(config)
    seen = 0
    for frame, boxes in walk(seed).items():
        if not boxes:
            continue
        data = np.array(boxes)
        got = [r[:-1] for r in ours.step(frame, data[:, :4], data[:, 4])]
        expected = plain.step(frame, boxes)
        assert [r[0] for r in got] == [r[0] for r in expected]
        if got:
            assert np.allclose(got, expected)
        seen += len(got)
    assert seen > 20


def detection_rows(matches: int = 3) -> list[tuple]:
    return [(m, frame, 10 * k, *b, 0) for m in range(matches) for frame, boxes in walk(m).items() for k, b in enumerate(boxes)]


def rows_of(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()))


def test_any_partitioning_gives_the_same(spark):
    rows = detection_rows()
    expected = []
    for m in range(3):
        tracks = Tracks()
        for frame, boxes in walk(m).items():
            if boxes:
                expected += association.folded(m, frame, tracks, [(10 * k, *b) for k, b in enumerate(boxes)])
    for parts, batch in ((1, "10000"), (7, "13")):
        random.Random(parts).shuffle(rows)
        before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            assert rows_of(associate(spark.createDataFrame(rows, DETECTIONS).repartition(parts))) == sorted(expected)
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_lost_tracks_live_as_long_as_the_buffer():
    box, conf = np.array([[100.0, 100, 130, 160]]), np.array([0.9])
    for gap, same in ((31, True), (32, False)):  # unseen for 30 and for 31 frames
        tracks = Tracks(BALL_TRACKS)
        tracks.step(1, box, conf)
        tracks.step(2, box, conf)
        tracks.step(2 + gap, box, conf)
        again = tracks.step(3 + gap, box, conf)
        assert (again[0][0] == 1) is same


def test_awkward_boxes(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 5, 1, 10.0, 10.0, 40.0, 70.0, 0.9, 0), (1, 5, 2, 10.0, 10.0, 10.0, 70.0, 0.9, 0), (1, 5, 3, nan, 1.0, 2.0, 3.0, 0.9, 0), (1, 6, 4, 1.0, 1.0, inf, 3.0, 0.9, 0), (1, 6, 5, 11.0, 11.0, 41.0, 71.0, None, 0), (None, 6, 5, 11.0, 11.0, 41.0, 71.0, 0.9, 0), (1, 6, 6, 11.0, 11.0, 41.0, 71.0, 0.9, 0), (1, 6, 6, 11.0, 11.0, 41.0, 71.0, 0.9, 0)]
    got = rows_of(associate(spark.createDataFrame([(*r, "x") for r in rows], DETECTIONS + ", tid string")).select("match_id", "frame", "tid", "det_ord"))
    assert got == [(1, 5, 1, 1), (1, 6, 1, 6)]
    assert associate(spark.createDataFrame([], DETECTIONS)).count() == 0


def test_whole_way_from_detections(spark):
    """Detections become tracks, tracks players: the queries give what the steps give one by one."""
    rows = tables.detections(spark, SF)
    both = queries.associated_tracks(spark, SF)
    players = association.player_tracks(rows)
    assert rows_of(both.where("kind = 'player'").select("match_id", "frame", "ord", "tid")) == rows_of(players.select("match_id", "frame", "ord", "tid"))
    own = identity.Fold()
    log = [own.step(r.frame, r.tid, r.x1, r.y1, r.x2, r.y2) for r in players.orderBy("frame", "ord").collect()]
    assert queries.associated_observations(spark, SF).count() == sum(r[5] == "exported" and r[3] not in {t[3] for t in log if t[5] == "tombstoned"} for r in log)
    best = queries.associated_ball(spark, SF)
    assert rows_of(best.select("match_id", "frame", "x", "y")) == rows_of(ball.best_ball(association.ball_tracks(rows)).select("match_id", "frame", "x", "y"))
    plain = PlainTracker(PLAYER_TRACKS)
    frames: dict = {}
    for r in detections.valid_players(rows).orderBy("frame", "ord").collect():
        frames.setdefault(r.frame, []).append((float(r.x1), float(r.y1), float(r.x2), float(r.y2), r.conf))
    expected = [(0, f, t[0]) for f, boxes in frames.items() if len(boxes) <= 7 for t in plain.step(f, boxes)]
    if all(len(b) <= 7 for b in frames.values()):
        assert sorted(expected) == rows_of(players.select("match_id", "frame", "tid"))
