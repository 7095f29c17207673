"""Periodic runs of words, found by probing a harmonic grid.

A run of period p and at least e periods has e - 1 neighbouring multiples of p
at which a word equals the word p later. For every p, words are compared on the
grid 0, p, 2p ...; all grids together have about n ln n points. Grid points that
agree in a row are probed at a few places between them, and what survives is
extended to both sides by comparing growing chunks. A run found with period d
also agrees on the grids of d's multiples, where it is skipped whole.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

MIN_LENGTH, MIN_EXPONENT = 6, 4
#: Up to so many words the grids of all periods are looked up in one table; longer texts take them one by one.
TABLE_WORDS = 8192
FIRST_CHUNK = 16
Words = list[bytes]
Edit = Callable[[str | None, Words], Words]


def words_of(text: bytes | None) -> Words:
    """Words between the white space x09-x0D and x20, as UTF-8; null counts as empty."""
    return (text or b"").split()


@lru_cache(1)
def _grids() -> tuple[np.ndarray, np.ndarray]:
    """All grid points of periods up to a quarter of the table as (later point, period), in order of the later point."""
    periods = [np.full((TABLE_WORDS - 1) // p, p, np.int32) for p in range(1, TABLE_WORDS // 2 + 1)]
    later = np.concatenate([np.arange(p[0], TABLE_WORDS, p[0], dtype=np.int32)[: len(p)] for p in periods])
    order = np.argsort(later, kind="stable")
    return later[order], np.concatenate(periods)[order]


def _ahead(ids: np.ndarray, i: int, p: int) -> int:
    """The first place from i on whose word differs from the one p later."""
    last, chunk = len(ids) - p, FIRST_CHUNK
    while i < last:
        m = min(chunk, last - i)
        differ = ids[i : i + m] != ids[i + p : i + p + m]
        k = int(differ.argmax())
        if differ[k]:
            return i + k
        i, chunk = i + m, 2 * chunk
    return last


def _behind(ids: np.ndarray, i: int, p: int) -> int:
    """The first place of the stretch up to i in which each word equals the one p later."""
    chunk = FIRST_CHUNK
    while i > 0:
        m = min(chunk, i)
        differ = (ids[i - m : i] != ids[i - m + p : i + p])[::-1]
        k = int(differ.argmax())
        if differ[k]:
            return i - k
        i, chunk = i - m, 2 * chunk
    return 0


def _probed(ids: np.ndarray, at: np.ndarray, p: np.ndarray, agree: int) -> np.ndarray:
    """Which points begin ``agree`` grid points in a row, and agree at places between the first and the last."""
    n, ok = len(ids), np.ones(len(at), bool)
    rest = np.flatnonzero(at + agree * p < n)
    ok[:] = False
    for j in range(1, agree):
        rest = rest[ids[at[rest] + j * p[rest]] == ids[at[rest] + (j + 1) * p[rest]]]
    if agree > 1:
        for offset in (lambda q: q // 2, lambda q: q // 3, lambda q: q - 1, lambda q: 2 * q // 3, lambda q: q // 5, lambda q: (agree - 1) * q - 1):
            x = at[rest] + offset(p[rest])
            rest = rest[ids[x] == ids[x + p[rest]]]
    ok[rest] = True
    return ok


def _candidates(ids: np.ndarray, agree: int):
    """(period, grid points) by rising period, points rising."""
    n = len(ids)
    most = n // (agree + 1)
    if n <= TABLE_WORDS:
        later, period = _grids()
        size = int(np.searchsorted(later, n))
        later, period = later[:size], period[:size]
        hit = np.flatnonzero(ids[later] == ids[later - period])
        hit = hit[period[hit] <= most]
        at, p = later[hit] - period[hit], period[hit]
        ok = _probed(ids, at, p, agree)
        at, p = at[ok], p[ok]
        order = np.lexsort((at, p))
        at, p = at[order], p[order]
        for own in np.unique(p).tolist():
            yield own, at[np.searchsorted(p, own) : np.searchsorted(p, own, "right")]
        return
    for own in range(1, most + 1):
        grid = ids[::own]
        same = grid[1:] == grid[:-1]
        row = same[: len(same) - agree + 1].copy()
        for j in range(1, agree):
            row &= same[j : len(same) - agree + 1 + j]
        if row.any():
            at = np.flatnonzero(row) * own
            at = at[_probed(ids, at, np.full(len(at), own), agree)]
            if len(at):
                yield own, at


def runs_of(words: Words, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the words, by start, then period.

    A run is a longest stretch with its smallest period, of ``min_exponent``
    periods (2 at least) and ``min_length`` words at least.
    """
    if min_exponent < 2:
        raise ValueError("a run has two periods at least")
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words))
    if len(number) == len(words):
        return []
    agree, found = min_exponent - 1, []
    known: dict[int, list[tuple[int, int]]] = defaultdict(list)  # period: where runs of its divisors are
    for p, at in _candidates(ids, agree):
        taken = sorted(known.pop(p, ()))
        if taken:
            # two runs of divisors may overlap, but by less than p words, so a point and the one p later lie in one at most
            starts, ends = np.array([s for s, _ in taken]), np.maximum.accumulate([e for _, e in taken])
            k = np.searchsorted(starts, at, "right") - 1
            at = at[(k < 0) | (at + p >= ends[np.maximum(k, 0)])]
        while len(at):
            i = int(at[0])
            right = _ahead(ids, i, p)
            if right > i:
                left = _behind(ids, i, p)
                length = right - left + p
                if length >= max(min_length, min_exponent * p):
                    found.append((left, length, p))
                    for multiple in range(2 * p, length // agree + 1, p):
                        known[multiple].append((left, left + length))
            at = at[np.searchsorted(at, max(right, i + 1)) :]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: Words, runs: list[tuple[int, int, int]]) -> Words:
    """The words without those that a run repeats after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def strongest(runs: list[tuple[int, int, int]]) -> int | None:
    """Index of the run with the largest exact length / period; ties: smallest start, then period."""
    best = None
    for k, (_, length, period) in enumerate(runs):
        if best is None or length * runs[best][2] > runs[best][1] * period:
            best = k
    return best


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, edit: Edit | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs (array of start, length, period), strongest (its index), collapsed.

    ``edit`` may change the words of a text before, given its id as a string.
    Null text counts as empty: no words, no runs, an empty ``collapsed``. A
    text's work is in proportion to n log n, its memory to n, whatever its
    length. Runs of one start are in order of period; of equally strong runs the
    first counts. Repeated rows are looked at each for itself, null ids too. An
    empty table gives an empty result; other columns are ignored.
    """

    def scan(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"n_words": [], "runs": [], "strongest": [], "collapsed": []}
        names = batch.column("name").to_pylist() if edit else [None] * batch.num_rows
        for name, text in zip(names, batch.column("text").to_pylist(), strict=True):
            words = words_of(text)
            if edit:
                words = edit(name, words)
            runs = runs_of(words, min_length, min_exponent)
            out["n_words"].append(len(words))
            out["runs"].append([{"start": s, "length": n, "period": p} for s, n, p in runs])
            out["strongest"].append(strongest(runs))
            out["collapsed"].append(b" ".join(collapsed(words, runs)))
        kinds = {"n_words": pa.int64(), "runs": _RUNS, "strongest": pa.int32(), "collapsed": pa.binary()}
        return {"doc_id": batch.column("doc_id")} | {k: pa.array(v, kinds[k]).cast(pa.string()) if k == "collapsed" else pa.array(v, kinds[k]) for k, v in out.items()}

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(id_col).cast("string").alias("name"), F.col(text_col).cast("string").cast("binary").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, scan, f"doc_id {id_type}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, strongest int, collapsed string")


def repeat_from(name: str | None, words: Words) -> Words:
    """The query's damage: in a tenth of the texts, chosen by a hash of the id, words repeat from some place on. Null ids have none."""
    h = zlib.crc32(name.encode()) if name is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query from those of ``periodic_runs``."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.get("runs", F.col("strongest"))
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("(runs[strongest].length * 1000) div runs[strongest].period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )
