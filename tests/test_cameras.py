"""Two cameras against plain loops."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

from pitchfold.operators import cameras
from pitchfold.plans import queries

PLANE = "match_id bigint, frame bigint, id int, px double, py double"
SF = "/root/testdata/sf0.001"


def made_up(seed: int, frames: int = 40, players: int = 9):
    """Players on a field; one camera sees its left part, the other its right part, with ids of its own and small errors."""
    rng = random.Random(seed)
    place = [[rng.uniform(0, 40), rng.uniform(0, 20)] for _ in range(players)]
    other = rng.sample(range(1, 14), players)
    first, second, truth = [], [], []
    for f in range(frames):
        for p, at in enumerate(place):
            at[0], at[1] = at[0] + rng.uniform(-1, 1), at[1] + rng.uniform(-1, 1)
            left, right = at[0] < 26, at[0] > 14
            if left:
                first.append((seed, f, p + 1, at[0], at[1]))
            if right:
                second.append((seed, f, other[p], at[0] + rng.uniform(-0.2, 0.2), at[1] + rng.uniform(-0.2, 0.2)))
            if left or right:
                truth.append((seed, f, p + 1, other[p] if right else None))
    return first, second, truth


def plain(first, second, reach, players):
    by_frame = defaultdict(lambda: ([], []))
    for rows, k in ((first, 0), (second, 1)):
        for m, f, i, x, y in rows:
            by_frame[m, f][k].append((i, x, y))

    def greedy(pairs):
        taken = []
        for _, a, b in sorted(pairs):
            if not any(a == x or b == y for x, y in taken):
                taken.append((a, b))
        return taken

    chosen, votes = {}, defaultdict(Counter)
    for key, (a, b) in by_frame.items():
        chosen[key] = greedy([((i[1] - j[1]) * (i[1] - j[1]) + (i[2] - j[2]) * (i[2] - j[2]), i[0], j[0]) for i in a for j in b if (i[1] - j[1]) ** 2 + (i[2] - j[2]) ** 2 <= reach**2])
        votes[key[0]].update(chosen[key])
    same = {m: {b: a for a, b in greedy([(-n, a, b) for (a, b), n in v.items()])} for m, v in votes.items()}
    out = []
    for (m, f), (a, b) in by_frame.items():
        of = dict(chosen[m, f])
        at = {j[0]: j for j in b}
        for i, x, y in a:
            k = of.get(i)
            out.append((m, f, i, i, k, (x + at[k][1]) / 2 if k else x, (y + at[k][2]) / 2 if k else y))
        for i, x, y in b:
            if i not in of.values():
                s = same.get(m, {}).get(i)
                out.append((m, f, s if s is not None and s not in {q[0] for q in a} else i + players, None, i, x, y))
    return sorted(out, key=repr)


def test_against_plain_loops(spark):
    first, second = [], []
    for seed in range(4):
        a, b, _ = made_up(seed)
        first += a
        second += b
    got = cameras.merged(spark.createDataFrame(first, PLANE), spark.createDataFrame(second, PLANE), 2.0, 13)
    assert sorted(map(tuple, got.collect()), key=repr) == plain(first, second, 2.0, 13)


def test_no_player_twice_and_none_lost(spark):
    first, second, truth = made_up(7)
    got = cameras.merged(spark.createDataFrame(first, PLANE), spark.createDataFrame(second, PLANE), 1.0, 13).collect()
    assert len({(r["frame"], r["person"]) for r in got}) == len(got)
    assert {(r["frame"], "a", r["a"]) for r in got if r["a"]} == {(f, "a", i) for _, f, i, *_ in first}
    assert {(r["frame"], "b", r["b"]) for r in got if r["b"]} == {(f, "b", i) for _, f, i, *_ in second}
    assert abs(len(got) - len(truth)) <= 0.05 * len(truth)  # near players may be taken for each other, or stand apart


def test_planes_and_plan(spark):
    seen = spark.createDataFrame([(1, 1, 0, 3, 10, 20), (1, 2, 0, 4, 10, 20), (1, 3, 0, 5, 1, 1)], "match_id bigint, camera_id bigint, frame bigint, id int, x bigint, y bigint")
    unit = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
    doubled = (2.0, 0.0, 1.0, 0.0, 2.0, 0.0, 0.0, 0.0, 2.0)
    known = spark.createDataFrame([(1, 1, *unit), (1, 2, *doubled)], "match_id bigint, camera_id bigint, " + ", ".join(f"{c} double" for c in cameras._MATRIX))
    assert sorted(tuple(r) for r in cameras.on_plane(seen, known).collect()) == [(1, 1, 0, 3, 10.0, 20.0), (1, 2, 0, 4, 10.5, 20.0)]
    first, second, _ = made_up(1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = cameras.seen_by_both(spark.createDataFrame(first, PLANE), spark.createDataFrame(second, PLANE), 1.0)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin [match_id" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_query(spark):
    got = queries.two_cameras(spark, SF).collect()
    assert got and len({(r["match_id"], r["frame"], r["person"]) for r in got}) == len(got)
    whole = {(r["match_id"], r["frame"], r["id"]) for r in queries.player_observations(spark, SF).collect()}
    assert {(r["match_id"], r["frame"], r["a"]) for r in got if r["a"]} | {(r["match_id"], r["frame"], 14 - r["b"]) for r in got if r["b"]} == whole
