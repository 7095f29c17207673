"""The stream gives what the batch gives, whatever order the micro-batches bring."""

from __future__ import annotations

import random
import time

from pitchfold.operators import detections, identity
from pitchfold.operators.identity import Fold
from pitchfold.config import Tracking
from pitchfold.sources import tables
from pitchfold.streaming.identity import LATE, dump, load, read_tracks, resolve_stream

TRACKS = "match_id bigint, frame bigint, ord bigint, tid bigint, x1 bigint, y1 bigint, x2 bigint, y2 bigint"


def _run(spark, source, folder, name, lag):
    query = resolve_stream(read_tracks(spark, source, 1), lag=lag).writeStream.format("parquet").option("checkpointLocation", f"{folder}/check-{name}").outputMode("append").trigger(availableNow=True).start(f"{folder}/log-{name}")
    assert query.awaitTermination(240)
    return spark.read.parquet(f"{folder}/log-{name}")


def test_stream_equals_batch(spark, tmp_path):
    folder = f"file://{tmp_path}"
    tracks = detections.player_tracks(tables.detections(spark, "/root/testdata/sf0.001"))
    rows = [tuple(r) for r in tracks.select(*[c.split()[0] for c in TRACKS.split(", ")]).orderBy("frame").collect()]
    rows += [(1, *r[1:]) for r in rows[:120]]
    end = max(r[1] for r in rows) + 10
    third = len(rows) // 3
    order = sorted(rows, key=lambda r: r[1])
    batches = [order[:third], order[third : 2 * third], order[2 * third :] + [(m, end, -1, 0, 0, 0, 0, 0) for m in (0, 1)]]
    late = (0, order[0][1], 999_999, 5, 100, 100, 150, 150)
    batches.append([late])
    rng = random.Random(1)
    for k, batch in enumerate(batches):
        rng.shuffle(batch)
        spark.createDataFrame(batch, TRACKS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    log = _run(spark, f"{folder}/in", folder, "a", lag=2)
    expected = identity.resolve(spark.createDataFrame(rows, TRACKS))
    got = log.where(f"status <> '{LATE}'").select(*expected.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, expected.collect()), key=repr)
    assert [r["ord"] for r in log.where(f"status = '{LATE}'").collect()] == [999_999]
    a, b = identity.observations(log), identity.observations(expected)
    assert sorted(a.collect()) == sorted(b.collect())


def test_a_silent_match_is_flushed(spark, tmp_path):
    """Without a closing row: the last frames come out, and the state goes, once the match is idle."""
    folder = f"file://{tmp_path}"
    tracks = detections.player_tracks(tables.detections(spark, "/root/testdata/sf0.001"))
    rows = [tuple(r) for r in tracks.select(*[c.split()[0] for c in TRACKS.split(", ")]).orderBy("frame", "ord").collect()][:200]
    for part in (rows[:100], rows[100:]):
        spark.createDataFrame(part, TRACKS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    query = resolve_stream(read_tracks(spark, f"{folder}/in", 1), lag=2, idle_ms=8000).writeStream.format("parquet").option("checkpointLocation", f"{folder}/check").outputMode("append").trigger(processingTime="200 milliseconds").start(f"{folder}/log")
    expected = identity.resolve(spark.createDataFrame(rows, TRACKS))
    try:
        for _ in range(100):
            time.sleep(1)
            if list(tmp_path.glob("log/_spark_metadata/*")) and spark.read.schema(expected.schema).parquet(f"{folder}/log").count() == len(rows):
                break
    finally:
        query.stop()
    log = spark.read.parquet(f"{folder}/log").select(*expected.columns)
    assert sorted(map(tuple, log.collect()), key=repr) == sorted(map(tuple, expected.collect()), key=repr)


def test_state_round_trip():
    fold = Fold()
    for i in range(20):
        for tid in range(1, 9):
            fold.step(i, tid, tid * 60, i, tid * 60 + 20, i + 20)
    again = load(Tracking(), *dump(fold))
    assert again.slots == fold.slots and again.by_tid == fold.by_tid
