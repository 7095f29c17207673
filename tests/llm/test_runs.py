"""Periodic runs against their definition."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pitchfold.llm import periodic_runs, queries
from pitchfold.llm.periodic_runs import collapsed, runs_of, strongest

from .helpers import SF, awkward, awkward_rows, documents, empty


def plain_runs(words: list, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """Every longest stretch of each period, kept if the period is its smallest; straight from the definition."""
    n, found = len(words), []
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j - i + p if j > i else 0
            part = words[i : i + length]
            if length >= max(least, times * p) and not any(part[q:] == part[:-q] for q in range(1, p)):
                found.append((i, length, p))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b"]), max_size=60) | st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=40), st.integers(2, 5))
def test_small_texts(words, times):
    assert runs_of(words, 6, times) == plain_runs(words, 6, times)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("abc", min_size=1, max_size=6), st.integers(1, 9)), max_size=8))
def test_repeated_pieces(pieces):
    words = [c.encode() for piece, k in pieces for c in piece * k]
    assert runs_of(words) == plain_runs(words)


@pytest.mark.parametrize("limit", [1, 8192])
def test_long_texts_take_the_grids_one_by_one(monkeypatch, limit):
    monkeypatch.setattr(periodic_runs, "TABLE_WORDS", limit)
    periodic_runs._grids.cache_clear()
    rng = random.Random(5)
    words: list[bytes] = []
    while len(words) < 600:
        piece = [rng.choice([b"x", b"y", b"z", b"w"]) for _ in range(rng.randrange(1, 25))]
        words += piece * rng.choice([1, 1, 4, 6, 5]) + piece[: rng.randrange(len(piece))]
    assert runs_of(words) == plain_runs(words)
    periodic_runs._grids.cache_clear()


def test_runs_of_two_periods_overlap_and_drop_words():
    words = "p a b a b a b a b q x x x x x x x".split()
    runs = runs_of(words)
    assert runs == [(1, 8, 2), (10, 7, 1)] and strongest(runs) == 1
    assert collapsed(words, runs) == "p a b q x".split()
    assert strongest([(0, 8, 2), (9, 12, 3)]) == 0 and strongest([]) is None


@pytest.mark.parametrize("words", [[b"a"] * 300_000, [b"a", b"b", b"c"] * 100_000, [b"a"] * 100_000 + [b"b"] * 100_000 + [b"a"] * 100_000])
def test_long_runs_take_no_square_time(words):
    began = time.perf_counter()
    assert len(runs_of(words)) <= 3
    assert time.perf_counter() - began < 20


def test_random_long_text_of_two_words():
    rng = random.Random(2)
    words = [rng.choice([b"a", b"b"]) for _ in range(50_000)]
    began = time.perf_counter()
    runs_of(words)
    assert time.perf_counter() - began < 20


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    four = (*best, best[1] * 1000 // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *four, sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_query_over_the_whole_table(spark):
    got = queries.op11_periodic_runs(spark, SF).select(*COLUMNS).collect()
    assert sorted(map(tuple, got)) == sorted(expected(d, t) for d, t in documents()[["doc_id", "text"]].itertuples(index=False))
    assert sum(r["n_runs"] > 0 for r in got) > 5


def test_awkward_tables(spark):
    rows = [r for r in awkward_rows() if len(r[1] or "") < 5000]
    docs = awkward(spark).where("text IS NULL OR length(text) < 5000")
    got = periodic_runs.digest(periodic_runs.periodic_runs(docs, edit=periodic_runs.repeat_from)).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((expected(r[0], r[1]) for r in rows), key=repr)
    assert periodic_runs.periodic_runs(awkward(spark)).count() == len(awkward_rows())
    assert periodic_runs.periodic_runs(empty(spark)).count() == 0
