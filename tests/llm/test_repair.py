"""Conversation repair against exhaustive search and a plain sequential search."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pitchfold.llm import queries, turn_repair
from pitchfold.llm.turn_repair import BLANK, CUT, DUPLICATE, SOUND, Tree, cheapest, turn_matrix

from .helpers import SF

TURNS = "conv_id bigint, turn bigint, role string, text string"


def plain_audit(turns: list[tuple[str, int]]) -> tuple[int, str, list]:
    """Cost, audit and roles over all edits, from left to right: the best for each state after each turn.

    Ways of one state after one turn have equally many letters but for insertions, so the least stays least.
    """
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    def filled(best):
        for _ in range(3):
            for state, (cost, audit, roles) in list(best.items()):
                for r, name in (("u", "user"), ("a", "assistant")):
                    if (state, r) in step:
                        way = (cost + 2, audit + "I", [*roles, name + "+"])
                        to = step[state, r]
                        if to not in best or way[:2] < best[to][:2]:
                            best[to] = way
        return best

    best = filled({"": (0, "", [])})
    for k, (role, fault) in enumerate(turns):
        new: dict = {}

        def offer(state, way, new=new):
            if state not in new or way[:2] < new[state][:2]:
                new[state] = way

        for state, (cost, audit, roles) in best.items():
            offer(state, (cost + 3, audit + "D", roles))
            if fault in (BLANK, DUPLICATE):
                continue
            extra = fault == CUT
            if (state, role[:1]) in step:
                offer(step[state, role[:1]], (cost + extra, audit + "K", [*roles, k]))
            for r, name in (("u", "user"), ("a", "assistant")):
                if (state, r) in step:
                    offer(step[state, r], (cost + 2 + extra, audit + "R", [*roles, (k, name)]))
        best = filled(new)
    return min((best[e] for e in ("", "a") if e in best), key=lambda w: w[:2])


def all_ways(turns: list[tuple[str, int]]) -> tuple[int, str]:
    """By exhaustive search over deletions, roles and up to two insertions at each place."""
    best = None
    gaps = ["", "u", "a", "ua", "au"]

    def go(k, cost, audit, roles):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        for gap in gaps:
            c, a, r = cost + 2 * len(gap), audit + "I" * len(gap), roles + gap
            if k == len(turns):
                if re.fullmatch("(s?(ua)+)?", r) and (best is None or (c, a) < best):
                    best = (c, a)
                continue
            role, fault = turns[k]
            go(k + 1, c + 3, a + "D", r)
            if fault in (SOUND, CUT):
                go(k + 1, c + (fault == CUT), a + "K", r + (role[:1] or "?"))
                for to in "ua":
                    go(k + 1, c + 2 + (fault == CUT), a + "R", r + to)

    go(0, 0, "", "")
    return best


TURN = st.tuples(st.sampled_from(["system", "user", "assistant", "tool", ""]), st.sampled_from([SOUND, SOUND, SOUND, CUT, BLANK, DUPLICATE]))


def product(turns):
    tree = Tree()
    for role, fault in turns:
        tree.add(turn_matrix(role[:1], fault))
    return tree.product()


@settings(max_examples=60, deadline=None)
@given(st.lists(TURN, max_size=4))
def test_against_exhaustive_search(turns):
    assert cheapest(product(turns)) == all_ways(turns) == plain_audit(turns)[:2]


@settings(max_examples=200, deadline=None)
@given(st.lists(TURN, max_size=30), st.integers(0, 30))
def test_any_cut_gives_the_same(turns, cut):
    whole = cheapest(product(turns))
    assert whole == plain_audit(turns)[:2]
    assert cheapest(turn_repair.times(product(turns[:cut]), product(turns[cut:]))) == whole


def test_powers():
    m = turn_matrix("u", DUPLICATE)
    assert turn_repair.power(m, 13) == product([("user", DUPLICATE)] * 13)


def plain_rows(rows: list[tuple]) -> list[tuple]:
    """The query's rows for rows (conv_id, turn, role, text) in order, by its contract."""
    after: dict = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        plain = lambda v: " " if v is None else str(v)
        h = zlib.crc32(f"{plain(conv)}:{plain(turn)}".encode()) % 20
        own = after.setdefault(conv, [])
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        own += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    out = []
    for conv, own in after.items():
        key = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], key(r)))
        seen, turns = set(), []
        for _, role, text in own:
            bare = text.strip("\x20\t\n\x0b\x0c\r")
            fault = BLANK if not bare else DUPLICATE if (role, text) in seen else CUT if bare[-1] not in ".!?" else SOUND
            seen.add((role, text))
            turns.append((role, fault))
        numbers = [t for t, *_ in own if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in zip(turns, turns[1:]))
        cost, audit, kept = plain_audit(turns)
        lines = [f"{k[:-1]}:" if isinstance(k, str) else f"{own[k][1]}:{own[k][2]}" if isinstance(k, int) else f"{k[1]}:{own[k[0]][2]}" for k in kept]
        count = lambda f: sum(fault == f for _, fault in turns)  # noqa: B023, E731
        out.append((conv, gaps, count(BLANK), count(DUPLICATE), count(CUT), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()), key=repr)


def test_query_over_the_whole_table(spark):
    sf = SF.replace("0.001", "0.01")
    rows = pd.read_parquet(f"{sf}/conversations.parquet")[["conv_id", "turn", "role", "text"]]
    assert got(queries.op12_turn_repair(spark, sf)) == plain_rows(list(rows.itertuples(index=False, name=None)))


def awkward_turns() -> list[tuple]:
    rng = random.Random(3)
    roles = ["user", "assistant", "system", "tool", "", None, "User", "ukelele"]
    rows = [(None, None, None, None), (None, 3, "user", "x."), (7, None, "user", "a!"), (7, None, "user", "a!"), (7, 2, "assistant", None), (8, 1, "user", ""), (9, 4, "system", "only."), (10, 1, "user", "Ünïcode 𝄞?"), (10, 9, "assistant", "y" * 100_000 + "."), (-4, -5, "user", "  "), (-4, 2, "assistant", "b. \x0b\r")]
    for conv in range(20, 60):
        for turn in range(rng.randrange(1, 9)):
            rows.append((conv, rng.choice([turn, turn, turn + 2, None]), rng.choice(roles), rng.choice(["one.", "two", "", " ", "three?", None, "one."])))
    rows += [(99, k, rng.choice(["user", "assistant"]), f"text {rng.randrange(900)}{rng.choice(['.', ''])}") for k in range(4000)]
    rows += [(98, 5, "user", "the same.")] * 500
    return rows


@pytest.mark.parametrize("partitions", ["1", "40"])
def test_awkward_and_long_conversations(spark, partitions):
    """One conversation holds most turns and lies in many tasks, so its products are joined in levels."""
    rows = awkward_turns()
    random.Random(1).shuffle(rows)
    before, adaptive = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], TURNS + ", audit string, cost string, what string").repartition(5)
        assert got(turn_repair.repair_digest(turns)) == plain_rows(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)


def test_repaired_turns_are_sound(spark):
    turns = spark.createDataFrame(awkward_turns(), TURNS)
    left = turn_repair.repaired(turns, turn_repair.audits(turns)).toPandas().sort_values(["conv_id", "position"])
    for _, own in left.groupby("conv_id", dropna=False):
        assert re.fullmatch("s?(ua)+", "".join(r[:1] for r in own["role"]))


def test_empty_table(spark):
    turns = spark.createDataFrame([], TURNS)
    assert turn_repair.repair_digest(turns).count() == 0 and turn_repair.audits(turns).count() == 0
