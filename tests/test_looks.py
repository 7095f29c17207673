"""Re-identification by look: a plain fold, the gate off, and the stream."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from pitchfold.config import Tracking
from pitchfold.operators import detections, identity
from pitchfold.plans import queries
from pitchfold.sources import tables
from pitchfold.streaming.identity import read_tracks, resolve_stream

SF = "/root/testdata/sf0.001"
TRACKS = "match_id bigint, frame bigint, ord bigint, tid bigint, x1 bigint, y1 bigint, x2 bigint, y2 bigint"
GATED = Tracking(players=4, min_cosine=0.7)


class PlainFold:
    """The rules of the fold with dicts, as a list of them reads."""

    def __init__(self, config):
        self.c, self.of, self.pool, self.at, self.last, self.seen, self.dead, self.look = config, {}, list(range(1, config.players + 1)), {}, {}, defaultdict(list), set(), {}
        self.frame = None

    def step(self, frame, tid, x1, y1, x2, y2, look):
        c = self.c
        if frame != self.frame:
            self.frame, self.active, self.boxes = frame, set(), []
        x, y = (x1 + x2) // 2, (y1 + y2) // 2

        def iou(b):
            w, h = min(x2, b[2]) - max(x1, b[0]), min(y2, b[3]) - max(y1, b[1])
            i = max(w, 0) * max(h, 0)
            u = (x2 - x1) * (y2 - y1) + (b[2] - b[0]) * (b[3] - b[1]) - i
            return i / u if i > 0 and u > 0 else 0

        if any(iou(b) > c.max_overlap for b in self.boxes):
            self.boxes.append((x1, y1, x2, y2))
            if tid in self.of:
                k = self.of[tid]
                self.at[k], self.last[k] = (x, y), frame
                self.active.add(k)
                return k, "occluded"
            return None, "dropped"
        if tid in self.of:
            k, begins = self.of[tid], False
        elif self.pool:
            k, begins = self.pool.pop(0), True
        else:
            def cosine(k):
                a, b = self.look.get(k), look
                if a is None or b is None:
                    return 1.0
                return float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))

            near = [((self.at[k][0] - x) ** 2 + (self.at[k][1] - y) ** 2, k) for k in self.at if k not in self.active and frame - self.last[k] >= c.min_absence and cosine(k) >= c.min_cosine]
            near = [n for n in near if n[0] <= c.max_distance**2]
            if not near:
                return None, "dropped"
            k, begins = min(near)[1], False
            self.of = {t: i for t, i in self.of.items() if i != k}
        self.of[tid] = k
        self.at[k], self.last[k] = (x, y), frame
        self.active.add(k)
        self.boxes.append((x1, y1, x2, y2))
        if begins or self.look.get(k) is None:
            self.look[k] = None if look is None else np.array(look, float)
        elif look is not None:
            self.look[k] = c.look_kept * self.look[k] + (1 - c.look_kept) * np.array(look, float)
        if k in self.dead:
            return k, "hidden"
        self.seen[k].append((x, y))
        if len(self.seen[k]) >= c.window:
            xs, ys = zip(*self.seen[k][-c.window :])
            if max(max(xs) - min(xs), max(ys) - min(ys)) < c.min_extent:
                self.dead.add(k)
                self.pool = sorted([*self.pool, k])
                self.of = {t: i for t, i in self.of.items() if i != k}
                return k, "tombstoned"
            self.seen[k] = self.seen[k][-c.window_kept :]
        return k, "exported"


def match(seed: int, frames: int = 120, players: int = 6) -> list[tuple]:
    """Players in two kinds of dress who come and go and get new tracker ids."""
    rng = random.Random(seed)
    place, tid, order, out = {p: [rng.randrange(100, 500), rng.randrange(100, 400)] for p in range(players)}, {p: p + 1 for p in range(players)}, 0, []
    away = dict.fromkeys(range(players), 0)
    for frame in range(frames):
        for p in range(players):
            if away[p] > 0:
                away[p] -= 1
                continue
            if rng.random() < 0.04:
                away[p], tid[p] = rng.randrange(5, 25), max(tid.values()) + 1
                continue
            if p:
                place[p] = [v + rng.randrange(-9, 10) for v in place[p]]
            x, y = place[p]
            look = None if rng.random() < 0.1 else [1.0 * (p % 2), 1.0 * (p % 2 == 0), rng.random() * 0.4]
            out.append((seed, frame, order, tid[p], x, y, x + 20, y + 40, look))
            order += 1
    return out


@pytest.mark.parametrize("seed", range(12))
def test_against_a_plain_fold(seed):
    fold, plain = identity.Fold(GATED), PlainFold(GATED)
    for _, frame, _, tid, *rest in match(seed):
        *_, k, _, status, _ = fold.step(frame, tid, *rest)
        assert (k, status) == plain.step(frame, tid, *rest)


def test_the_gate_tells_dresses_apart():
    ids = {gate: [identity.Fold(Tracking(players=2, min_cosine=gate)) for _ in range(1)][0] for gate in (None, 0.7)}
    for gate, fold in ids.items():
        fold.step(0, 1, 100, 100, 120, 140, [1.0, 0.0])
        fold.step(0, 2, 300, 100, 320, 140, [0.0, 1.0])
        far = fold.step(20, 3, 110, 100, 130, 140, [0.0, 1.0])  # nearest to the first, dressed as the second
        assert far[3] == (1 if gate is None else None if (300 - 110) > 200 else 2)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_without_the_gate_ids_are_as_before(spark):
    tracks = detections.player_tracks(tables.detections(spark, SF))
    looks = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(1, 400)] + [(3, [0.0, 0.0])], "vec_id bigint, embedding array<float>")
    with_looks = identity.with_looks(tracks, looks, "vec_id", "embedding")
    assert with_looks.count() == tracks.count()
    expected = rows_of(identity.resolve(tracks))
    assert rows_of(identity.resolve(with_looks)) == expected
    assert rows_of(identity.resolve(with_looks, Tracking(min_cosine=-1.0))) == expected
    assert rows_of(queries.reid_by_look(spark, SF)) != expected


def test_the_stream_remembers_looks(spark, tmp_path):
    folder, names = f"file://{tmp_path}", TRACKS + ", look array<double>"
    rows = [r for seed in (1, 2) for r in match(seed)]
    end = max(r[1] for r in rows) + 10
    cut = [[r for r in rows if a <= r[1] < b] for a, b in ((0, 50), (50, 90), (90, 200))]
    cut[-1] += [(m, end, -1, 0, 0, 0, 0, 0, None) for m in (1, 2)]
    for part in cut:
        random.Random(0).shuffle(part)
        spark.createDataFrame(part, names).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    query = resolve_stream(read_tracks(spark, f"{folder}/in", 1, looks=True), GATED, lag=1).writeStream.format("parquet").option("checkpointLocation", f"{folder}/check").outputMode("append").trigger(availableNow=True).start(f"{folder}/out")
    assert query.awaitTermination(240)
    expected = identity.resolve(spark.createDataFrame(rows, names), GATED)
    assert rows_of(spark.read.parquet(f"{folder}/out").select(*expected.columns)) == rows_of(expected)
