"""Language ID by rank-order profiles of character n-grams.

A profile is a language's most frequent 1- to 3-grams in order. A document's
own most frequent n-grams are compared to it by the out-of-place distance: the
sum of rank differences, and the profile's length for each n-gram it lacks.
Words are runs of letters, lower-cased and padded with one blank.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialise, slices, texts

PROFILE = 300
#: Characters that are counted at once, and n-grams that a task keeps before it hands on their counts.
COUNT_CHARS, KEPT_NGRAMS = 1 << 18, 1 << 19
#: Languages that can be learned; a profile of each goes to every task, PROFILE codes and ranks. More labels are an error.
MOST_LANGUAGES = 10_000
UNDETERMINED = "und"
#: A language is recognised from this share of the score that all but QUANTILE of its fitting rows of like length reach.
QUANTILE, MARGIN = 0.001, 0.85
#: Lengths with fewer fitting rows of a language go by the language's rows of any length.
LEAST_ROWS = 100
#: Between words, and behind a text among others.
_BLANK, _END = 32, 0


@functools.cache
def _letters() -> np.ndarray:
    """For each code point its lower case if it is a letter, else a blank."""
    table = np.full(0x110000, _BLANK, np.uint32)
    for start, end in ((0x41, 0xD800), (0xE000, 0x110000)):
        for c in range(start, end):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
    return table


def symbols(text: str) -> np.ndarray:
    """Padded letters of a text; empty if it has none."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    x = np.concatenate([[_BLANK], _letters()[points], [_BLANK]]).astype(np.uint64)
    x = x[np.append(True, (x[1:] != _BLANK) | (x[:-1] != _BLANK))]
    return x if len(x) > 1 else x[:0]


def ngrams(*these: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the distinct n-grams of some texts, ascending, and their counts; none reaches from one text into another."""
    x = np.concatenate([part for text in these for part in (symbols(text), [_END])]).astype(np.uint64) if len(these) > 1 else symbols(*these)
    if not len(x):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    inside = x != _END
    pairs = x[:-1] << np.uint64(21) | x[1:]
    two = inside[:-1] & inside[1:]
    codes = np.concatenate([x[inside & (x != _BLANK)], pairs[two], (pairs[:-1] << np.uint64(21) | x[2:])[two[:-1] & inside[2:]]])
    codes.sort()
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.empty(0, np.int64)
    return codes[first], np.diff(np.append(first, len(codes)))


def ranked(codes: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent codes in order; ties go by code."""
    return codes[np.argsort(-counts, kind="stable")[:most]]


@dataclass(frozen=True)
class Profiles:
    """codes: all n-grams of any profile, ascending; ranks[i, l]: rank of codes[i] in language l, or PROFILE."""

    langs: tuple[str, ...]
    codes: np.ndarray
    ranks: np.ndarray

    @staticmethod
    def of(profiles: dict[str, list[int]]) -> Profiles:
        langs = tuple(sorted(profiles))
        codes = np.unique(np.array([c for p in profiles.values() for c in p], np.uint64))
        ranks = np.full((len(codes), len(langs)), PROFILE, np.int64)
        for i, lang in enumerate(langs):
            own = np.array(profiles[lang], np.uint64)
            ranks[np.searchsorted(codes, own), i] = np.arange(len(own))
        return Profiles(langs, codes, ranks)

    def predict(self, text: str) -> tuple[str, float]:
        """Language and 1 - distance / largest distance; ties go to the first language by name."""
        own = ranked(*ngrams(text))
        if not len(own) or not self.langs:
            return UNDETERMINED, 0.0
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        known = self.codes[at] == own
        place = np.arange(len(own))[:, None]
        apart = np.where(known[:, None], np.abs(self.ranks[at] - place), PROFILE)
        apart = np.where(self.ranks[at] == PROFILE, PROFILE, apart).sum(0)
        best = int(apart.argmin())
        return self.langs[best], float(1 - apart[best] / (PROFILE * len(own)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Profiles from all labelled rows; null labels and texts are left out. Only PROFILE rows a language reach the driver."""
    return _fit(fitting_rows(labelled, text_col, lang_col))


def fitting_rows(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, text) of the rows to fit on: all that have a label and a text."""
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    if rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"{lang_col} has more than {MOST_LANGUAGES} values, so it does not name languages")
    return rows


class Counts:
    """Counts of n-grams by language, of many texts in bounded memory."""

    def __init__(self) -> None:
        self.parts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.size = 0

    def add(self, lang: str, these: list[str]) -> None:
        found = ngrams(*these)
        self.parts.setdefault(lang, []).append(found)
        self.size += len(found[0])

    def full(self) -> bool:
        """Whether more than KEPT_NGRAMS are kept even with equal ones put together, which is tried at twice as many."""
        if self.size <= 2 * KEPT_NGRAMS:
            return False
        self.parts = {lang: [merged(own)] for lang, own in self.parts.items()}
        self.size = sum(len(codes) for ((codes, _),) in self.parts.values())
        return self.size > KEPT_NGRAMS

    def take(self) -> Iterator[pa.RecordBatch]:
        for lang, own in self.parts.items():
            codes, n = merged(own)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(codes), pa.string()), "code": codes.astype(np.int64), "n": n.astype(np.int64)})
        self.parts, self.size = {}, 0


def merged(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One pair of ascending codes and their counts from several."""
    if len(counts) == 1:
        return counts[0]
    codes, n = (np.concatenate(x) for x in zip(*counts, strict=True))
    order = np.argsort(codes, kind="stable")
    codes, n = codes[order], n[order]
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.empty(0, np.int64)
    return codes[first], np.add.reduceat(n, first) if len(first) else n


def _fit(rows: DataFrame) -> Profiles:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()
        waiting: dict[str, list[str]] = {}
        chars = 0

        def settle() -> None:
            for lang, own in waiting.items():
                counts.add(lang, own)
            waiting.clear()

        for batch in slices(batches, 64):
            for text, lang in zip(texts(batch.column("text")), batch.column("lang").to_pylist(), strict=True):
                waiting.setdefault(lang, []).append(text)
                chars += len(text)
                if chars > COUNT_CHARS:
                    settle()
                    chars = 0
                    if counts.full():
                        yield from counts.take()
        settle()
        yield from counts.take()

    counted = rows.mapInArrow(count, "lang string, code bigint, n bigint")
    totals = counted.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    top = totals.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PROFILE)
    profiles: dict[str, list[int]] = {}
    for r in sorted(top.collect(), key=lambda r: (r["lang"], r["rank"])):
        profiles.setdefault(r["lang"], []).append(r["code"])
    return Profiles.of(profiles)


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score.

    Null texts and those without a letter are ``und`` with score 0; so is every
    text if nothing was learned. Languages at one distance go by name; repeated
    rows are judged alike. A text of any length counts whole. An empty table
    gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batch: pa.RecordBatch) -> dict:
        found = [profiles.predict(t) for t in texts(batch.column("text"))]
        return {"doc_id": batch.column("doc_id"), "lang_pred": pa.array([x for x, _ in found], pa.string()), "score": pa.array([x for _, x in found], pa.float64())}

    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Fit on the rows that are not held out, predict all: doc_id, held_out, lang_pred, score."""
    profiles = fit(docs.where(~held_out(F.col(id_col))), text_col, lang_col)
    return identify(docs, profiles, id_col, text_col).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def length_class(text: str) -> int:
    """Powers of two of the characters; scores rise with length."""
    return len(text).bit_length()


def score_bounds(rows: DataFrame, profiles: Profiles) -> dict[tuple[str, int | None], float]:
    """Least score by (language, length class), and by (language, None) for any length, from all fitting rows that get their own label.

    It is MARGIN of the exact QUANTILE, the n * QUANTILE-th least score of n, rounded
    up. An approximate one of twice the share only leaves out scores far above.
    """

    def run(batch: pa.RecordBatch) -> dict:
        own = texts(batch.column("text"))
        found = [profiles.predict(t) for t in own]
        return {"lang": batch.column("lang"), "pred": pa.array([x for x, _ in found], pa.string()), "length": pa.array([length_class(t) for t in own], pa.int32()), "score": pa.array([x for _, x in found], pa.float64())}

    scored = materialise(map_arrow(rows, run, "lang string, pred string, length int, score double").where("lang = pred").select("lang", "length", "score"), "scores")
    groups = scored.rollup("lang", "length").agg(F.percentile_approx("score", 2 * QUANTILE, 10_000).alias("roof"), F.count(F.lit(1)).alias("n")).where("lang IS NOT NULL")
    either = scored.withColumn("length", F.explode(F.array("length", F.lit(None).cast("int"))))
    counted = either.alias("s").join(F.broadcast(groups.alias("g")), F.expr("s.lang = g.lang AND s.length <=> g.length AND s.score <= g.roof")).groupBy("g.lang", "g.length", "g.n", "s.score").agg(F.count(F.lit(1)).alias("times"))
    upto = F.sum("times").over(Window.partitionBy("lang", "length").orderBy("score"))
    low = counted.withColumn("upto", upto).where(F.col("upto") >= F.ceil(QUANTILE * F.col("n"))).groupBy("lang", "length", "n").agg(F.min("score").alias("low"))
    return {(r["lang"], r["length"]): MARGIN * r["low"] for r in low.collect() if r["length"] is None or r["n"] >= LEAST_ROWS}


def recognised(docs: DataFrame, min_score: float | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is recognised: not ``und``, score at least ``min_score``.

    Without ``min_score`` the bound comes from the fitting rows, by language and length of text.
    Null texts and those without a letter go; repeated rows stay or go together.
    A text of any length counts whole. Languages at one distance go by name. An
    empty table gives an empty result; all columns are kept as they are.
    """
    if "lang" not in docs.columns:
        raise ValueError("docs needs a column lang to learn from")
    rows = fitting_rows(docs.where(~held_out(F.col("doc_id"))))
    profiles = _fit(rows)
    bounds = score_bounds(rows, profiles) if min_score is None else {}
    fields = docs.schema

    def known(text: str) -> bool:
        lang, score = profiles.predict(text)
        least = min_score if min_score is not None else bounds.get((lang, length_class(text)), bounds.get((lang, None), 0.0))
        return lang != UNDETERMINED and score >= least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array([known(t) for t in texts(batch.column("text"))], pa.bool_()))

    return docs.mapInArrow(run, fields)
