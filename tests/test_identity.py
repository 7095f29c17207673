"""The identity fold: hand-made cases, invariants on random matches, and its agreement with the window form."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pitchfold import schemas
from pitchfold.config import Tracking
from pitchfold.operators import ball, detections, identity, overlap, report, static
from pitchfold.operators.identity import EXPORTED, HIDDEN, OCCLUDED, TOMBSTONED, Fold, Slot
from pitchfold.sources import tables

TRACKS = "match_id bigint, frame bigint, ord bigint, tid bigint, x1 bigint, y1 bigint, x2 bigint, y2 bigint"


def _at(x: int, y: int, size: int = 10) -> tuple[int, int, int, int]:
    return x - size, y - size, x + size, y + size


def _full(lasts: dict[int, tuple[int, int, int]], active: set[int] = frozenset()) -> Fold:
    """A fold without a free id; ids that aren't named are far away."""
    fold = Fold()
    for k in range(13):
        x, y, frame = lasts.get(k + 1, (9000, 9000, 0))
        fold.slots[k] = Slot(100 + k, x, y, frame)
        fold.by_tid[100 + k] = k
    fold.frame, fold.active = 50, {i - 1 for i in active}
    return fold


@pytest.mark.parametrize(
    ("lasts", "active", "expected"),
    [
        ({3: (100, 300, 42)}, set(), 3),
        ({3: (100, 300, 43)}, set(), None),
        ({3: (100, 301, 42)}, set(), None),
        ({3: (110, 100, 10), 7: (90, 100, 10)}, set(), 3),
        ({3: (110, 100, 10), 7: (90, 100, 10)}, {3}, 7),
    ],
)
def test_positional_reidentification(lasts, active, expected):
    fold = _full(lasts, active)
    assert fold.step(50, 7, *_at(100, 100))[3] == expected
    assert (7 in fold.by_tid) == (expected is not None)


def _sightings(points: list[tuple[int, int]], gap: int = 1) -> list[str]:
    fold = Fold()
    return [fold.step(i * gap, 1, *_at(x, y))[5] for i, (x, y) in enumerate(points)]


def test_static_window():
    still = [(100, 100)]
    assert TOMBSTONED not in _sightings(still * 47)
    assert _sightings(still * 50)[46:] == [EXPORTED, TOMBSTONED, HIDDEN, HIDDEN]
    assert TOMBSTONED in _sightings(still * 47 + [(117, 100)])
    assert TOMBSTONED not in _sightings(still * 47 + [(118, 100)])
    assert _sightings(still * 48, gap=500)[47] == TOMBSTONED
    moving = [(i * 40, 100) for i in range(37)]
    assert _sightings(moving[:36] + [(5000, 100)] * 60).index(TOMBSTONED) == 83
    assert _sightings(moving + [(5000, 100)] * 90).index(TOMBSTONED) == 119


def test_static_id_goes_back_to_the_pool():
    fold = Fold()
    for i in range(47):
        for tid in range(1, 6):
            fold.step(i, tid, *_at(tid * 100, 100 + (0 if tid == 3 else 30 * i)))
    assert fold.step(47, 3, *_at(300, 100))[5] == TOMBSTONED
    assert fold.free == 13 - 5 + 1
    assert fold.step(48, 77, *_at(900, 900))[3:6] == (3, "recycled", HIDDEN)


def test_occlusion():
    fold = Fold()
    fold.step(0, 1, *_at(100, 100))
    fold.step(0, 2, *_at(500, 100))
    assert fold.step(1, 1, *_at(200, 100))[5] == EXPORTED
    assert fold.step(1, 2, *_at(201, 100))[2:6] == (True, 2, "known", OCCLUDED)
    assert (fold.slots[1].x, fold.slots[1].frame, len(fold.slots[1].seen)) == (201, 1, 1)
    assert fold.step(1, 3, *_at(201, 101))[2:5] == (True, None, "unknown")
    assert len(fold.boxes) == 3
    full = _full({})
    full.step(51, 7, *_at(100, 100))
    assert full.boxes == []  # an unresolved clear track covers nobody


def _match(seed: int, frames: int = 150, tracks: int = 18) -> list[tuple]:
    rng = random.Random(seed)
    rows, ord_ = [], 0
    place = {t: (rng.randrange(900), rng.randrange(500)) for t in range(tracks)}
    tid = {t: t + 1 for t in range(tracks)}
    for frame in range(frames):
        for t in rng.sample(range(tracks), rng.randrange(tracks)):
            if t % 4:
                place[t] = (place[t][0] + rng.randrange(-20, 21), place[t][1] + rng.randrange(-20, 21))
            if rng.random() < 0.03:
                tid[t] = max(tid.values()) + 1
            rows.append((0, frame, ord_, tid[t], *_at(*place[t], 15)))
            ord_ += 1
    return rows


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10_000))
def test_invariants(seed):
    fold, seen = Fold(), set()
    for _, frame, _, tid, *corners in _match(seed):
        *_, k, outcome, status, _ = fold.step(frame, tid, *corners)
        assert k is None or 1 <= k <= 13
        assert outcome != "duplicate"
        if status == EXPORTED:
            assert (frame, k) not in seen
            seen.add((frame, k))
        assert {t: i for i, t in enumerate(s.tid for s in fold.slots) if t} == fold.by_tid
        assert fold.free + len(fold.by_tid) == 13
        assert all(len(s.seen) < 48 for s in fold.slots)


@pytest.fixture(scope="module")
def log(spark):
    rows = [(m, *r[1:]) for m in range(6) for r in _match(m)]
    return spark.createDataFrame(rows, TRACKS), identity.resolve(spark.createDataFrame(rows, TRACKS)).cache()


def test_the_fold_does_not_depend_on_partitions(log):
    tracks, resolved = log
    again = identity.resolve(tracks.repartition(13))
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, resolved.collect()), key=repr)


def test_window_form_agrees_with_the_fold(log):
    _, resolved = log
    clear = resolved.where(f"id IS NOT NULL AND status <> '{OCCLUDED}'")
    by_window = static.static_keys(static.static_windows(clear, "id"), "id").select("match_id", "id", "frame")
    by_fold = resolved.where(f"status = '{TOMBSTONED}'").select("match_id", "id", "frame")
    assert by_fold.count() > 5
    assert sorted(by_window.collect()) == sorted(by_fold.collect())


def test_observations(log):
    _, resolved = log
    plain, joined = identity.observations(resolved), identity.observations_by_join(resolved)
    assert sorted(plain.collect()) == sorted(joined.collect())
    both = identity.observations(resolved, emit_occluded=True)
    assert both.where("en_oclusion").count() > 0
    assert both.where("NOT en_oclusion").count() == plain.count()


def test_csv(spark, log, tmp_path):
    _, resolved = log
    observed = identity.observations(resolved)
    assert report.write_players(resolved, f"file://{tmp_path}/p", one_file=True)
    back = spark.read.option("header", True).csv(f"file://{tmp_path}/p")
    assert back.columns == ["match_id", "frame", "id", "x", "y", "x1", "y1", "x2", "y2", "en_oclusion"]
    assert back.count() == observed.count() and {r[0] for r in back.select("en_oclusion").distinct().collect()} == {"False"}
    gone = resolved.where("status = 'exported'").limit(1).unionByName(resolved.where("status = 'exported'").limit(1).selectExpr(*[c if c != "status" else "'tombstoned' AS status" for c in resolved.columns]))
    assert report.write_players(gone, f"file://{tmp_path}/h", one_file=True)
    header = next((tmp_path / "h").glob("part-*")).read_text()
    assert header.strip() == "match_id,frame,id,x,y,x1,y1,x2,y2,en_oclusion"
    assert not report.write_players(resolved.limit(0), f"file://{tmp_path}/n")
    assert not report.write_csv(observed.limit(0), f"file://{tmp_path}/b", ["frame"])
    assert not (tmp_path / "n").exists() and not (tmp_path / "b").exists()


def test_ball_csv(spark, tmp_path):
    balls = ball.best_ball(spark.createDataFrame([(0, 5, 1, 0.5, 0.0, 0.0, 10.9, 10.0, 32), (0, 5, 2, 0.9, 4.0, 4.0, 9.0, 8.0, 32)], "match_id bigint, frame bigint, ord bigint, conf double, x1 double, y1 double, x2 double, y2 double, cls int"))
    assert report.write_ball(balls, f"file://{tmp_path}/ball", one_file=True)
    assert next((tmp_path / "ball").glob("part-*")).read_text().split() == ["match_id,frame,x,y", "0,5,6,6"]
    with pytest.warns(UserWarning, match="not detected"):
        assert not report.write_ball(balls.limit(0), f"file://{tmp_path}/none")
    assert not (tmp_path / "none").exists()


def test_lines_round_as_the_reference_does(spark):
    """One decimal, halves to even: 18.75 and 31.25 are exact."""
    rows = [(0, 1, 5, 4, 3, 2, 1, True, 18.75), (0, 2, 0, 0, 13, 0, 0, False, 31.25), (0, 3, 1, 1, 0, 0, 2, False, 20.04)]
    metrics = spark.createDataFrame(rows, "match_id bigint, frame bigint, n_dets_raw bigint, n_dets bigint, ids_assigned bigint, n_active bigint, n_static bigint, ball_detected boolean, minute double")
    labels = {r["frame"]: r["label"] for r in report.hud(metrics).collect()}
    assert labels == {r[1]: f"Min:{r[8]:.1f} | Dets:{r[3]}/{r[2]} | IDs:{r[4]}/13 | Activos:{r[5]} | Pelota:{'SI' if r[7] else 'NO'}" for r in rows}
    lines = {r["frame"]: r["line"] for r in report.progress_lines(metrics).collect()}
    assert lines == {r[1]: f"  Min {r[8]:.1f} | IDs:{r[4]}/13 | Activos:{r[5]} | Estáticos:{r[6]} | Pelota:{'SI' if r[7] else 'NO'}" for r in rows}


def test_stored_detections_are_skipped_by_frame(spark, tmp_path, capsys):
    rows = tables.detections(spark, "/root/testdata/sf0.01")
    stored = tables.store_detections(rows, f"file://{tmp_path}/detections")
    assert sorted(stored.collect()) == sorted(rows.collect())
    later = detections.from_start(stored, 29_130)
    later.explain()
    assert "PushedFilters: [IsNotNull(frame), GreaterThanOrEqual(frame,29130)]" in capsys.readouterr().out
    pruned = detections.from_start(tables.detections(spark, "/root/testdata/sf0.01", 29_130), 29_130)
    pruned.explain()
    assert "GreaterThanOrEqual(event_id,4308)" in capsys.readouterr().out
    assert sorted(later.collect()) == sorted(pruned.collect()) and later.count() == 5692


def test_props_are_parsed_once_a_row(spark, capsys):
    detections.valid_players(tables.detections(spark, "/root/testdata/sf0.01")).explain()
    assert capsys.readouterr().out.count("regexp_extract") == 1


def test_empty_tracks(spark):
    assert identity.resolve(spark.createDataFrame([], TRACKS)).count() == 0


def test_a_smaller_pool():
    fold = Fold(Tracking(players=1))
    assert fold.step(0, 1, *_at(0, 0))[3] == 1
    assert fold.step(0, 2, *_at(500, 0))[3:6] == (None, "unresolved", "dropped")


def test_nearest_absent_track_across_cells(spark):
    """Against all pairs, with positions on and around the borders of cells and below zero."""
    rng = random.Random(4)
    rows = []
    for k in range(120):
        x, y, begin = rng.choice([-201, -200, -1, 0, 199, 200, 201, 400, rng.randrange(-500, 900)]), rng.choice([0, 200, 399, rng.randrange(-300, 700)]), rng.randrange(60)
        rows += [(k % 2, begin + 3 * j, 10 * k + j, k + 1, x - 5, y - 5, x + 5, y + 5) for j in range(rng.randrange(1, 6))]
    got = {(r["match_id"], r["tid"]): (r["frame"], r["near_tid"], r["d2"]) for r in overlap.nearest_absent_track(spark.createDataFrame(rows, TRACKS)).collect()}
    by: dict = {}
    for m, f, _, t, a, b, c, d in rows:
        by.setdefault((m, t), []).append((f, (a + c) // 2, (b + d) // 2))
    assert got.keys() == by.keys()
    for (m, t), seen in by.items():
        frame, x, y = min(seen)
        near = []
        for (m2, t2), other in by.items():
            before = [o for o in other if o[0] < frame]
            if m2 == m and t2 != t and before:
                f, a, b = max(before)
                d2 = (a - x) ** 2 + (b - y) ** 2
                if frame - f >= 8 and d2 <= 40_000:
                    near.append((d2, t2))
        d2, who = min(near, default=(None, None))
        assert got[m, t] == (frame, who, d2)
    assert sum(v[1] is not None for v in got.values()) > 20


def test_typed_empty_tables_go_through_everything(spark):
    empty = lambda s: spark.createDataFrame([], s)
    rows = empty(schemas.DETECTIONS)
    assert detections.valid_players(rows).count() == detections.frame_counts(rows).count() == 0
    assert tables.video_meta(rows).count() == tables.video_meta_derived(empty(schemas.VIDEO_META)).count() == 0
    assert tables.video_meta(rows).columns == empty(schemas.VIDEO_META).columns
    assert ball.best_ball(empty(schemas.TRACKS_BALL)).count() == 0 and set(schemas.BALL_OBSERVATIONS) <= set(ball.best_ball(empty(schemas.TRACKS_BALL)).columns)
    tracks = empty(schemas.TRACKS_PLAYER)
    assert overlap.nearest_absent_track(tracks).count() == overlap.occlusion_candidates(tracks).count() == 0
    log = identity.resolve(tracks)
    assert log.schema == empty(schemas.RESOLVED).schema
    assert identity.observations(log).columns == schemas.OBSERVATIONS and identity.observations(log).count() == 0
