"""Language ID: held-out accuracy, the distance against a plain one, and what may be learned from."""

from __future__ import annotations

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pitchfold.llm import language_id, queries
from pitchfold.llm.language_id import PROFILE, Profiles, ngrams

from .helpers import SF, documents, rows_of, words


def _grams(text: str) -> Counter:
    out: Counter = Counter()
    padded = " " + " ".join("".join(c.lower() if c.isalpha() else " " for c in text).split()) + " "
    for n in (1, 2, 3):
        for i in range(len(padded) - n + 1):
            if padded[i : i + n] != " ":
                out[padded[i : i + n]] += 1
    return out


def _code(gram: str) -> int:
    out = 0
    for c in gram:
        out = out << 21 | ord(c)
    return out


def test_ngrams():
    for text in ("", "Hello, World 42!", "a", "É É é", "中文 naïve\nline"):
        codes, counts = ngrams(text)
        assert dict(zip(codes.tolist(), counts.tolist())) == {_code(g): n for g, n in _grams(text).items()} if any(map(str.isalpha, text)) else not len(codes)


def test_out_of_place_distance():
    texts = {"en": "the cat and the dog and the house", "fr": "le chat et le chien et la maison"}
    order = {k: [g for g, _ in sorted(_grams(t).items(), key=lambda x: (-x[1], _code(x[0])))][:PROFILE] for k, t in texts.items()}
    profiles = Profiles.of({k: [_code(g) for g in v] for k, v in order.items()})
    for text in ("the house", "la maison et le chat", "xyz"):
        own = [g for g, _ in sorted(_grams(text).items(), key=lambda x: (-x[1], _code(x[0])))]
        far = {k: sum(abs(v.index(g) - i) if g in v else PROFILE for i, g in enumerate(own)) for k, v in order.items()}
        best = min(sorted(far), key=far.get)
        assert profiles.predict(text) == (best, 1 - far[best] / (PROFILE * len(own)))
    assert profiles.predict("123") == ("und", 0.0) == Profiles.of({}).predict("text")


def test_held_out_accuracy(spark):
    sf = SF.replace("0.001", "0.01")
    got = {r["doc_id"]: r for r in queries.op7_language_id(spark, sf).collect()}
    right = asked = 0
    docs = documents(sf)
    assert len(got) == len(docs)
    for doc_id, text, lang in docs[["doc_id", "text", "lang"]].itertuples(index=False):
        r = got[doc_id]
        assert r["held_out"] == (zlib.crc32(str(doc_id).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        if not any(map(str.isalpha, text or "")):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif r["held_out"] and lang is not None:
            asked += 1
            right += r["lang_pred"] == lang
    assert asked > 100 and right / asked > 0.95


def test_only_text_and_labels_of_the_fitting_rows_count(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    changed = docs.withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("other"))
    assert rows_of(language_id.language_id(docs)) == rows_of(language_id.language_id(changed))


def test_rejection_keeps_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame([(10**9, "1234 !!", None, None, 7)], "doc_id bigint, text string, lang string, source string, n_chars bigint"), allowMissingColumns=True)
    kept = language_id.recognised(docs)
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} >= {d for d, t in documents()[["doc_id", "text"]].itertuples(index=False) if len((t or "").split()) > 30}
    assert kept.where("doc_id = 1000000000").count() == 0


def _learned(rows) -> dict[str, list[str]]:
    """Profiles of all rows (doc_id, text, lang) that are not held out, without Spark; no language here has more than FIT_ROWS."""
    counted: dict[str, Counter] = {}
    for doc_id, text, lang in rows:
        if text is not None and lang is not None and zlib.crc32(str(doc_id).encode()) % 5:
            counted.setdefault(lang, Counter()).update(_grams(text))
    return {lang: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], _code(x[0])))[:PROFILE]] for lang, c in counted.items()}


def _predicted(text: str, profiles: dict[str, list[str]]) -> tuple[str, float]:
    own = [g for g, _ in sorted(_grams(text or "").items(), key=lambda x: (-x[1], _code(x[0])))[:PROFILE]]
    if not own or not any(map(str.isalpha, text)):
        return "und", 0.0
    far = {lang: sum(abs(place[g] - i) if g in place else PROFILE for i, g in enumerate(own)) for lang, p in profiles.items() for place in [{g: i for i, g in enumerate(p)}]}
    best = min(sorted(far), key=far.get)
    return best, 1 - far[best] / (PROFILE * len(own))


def test_predictions_of_a_whole_table_by_their_definition(spark):
    rows = list(documents()[["doc_id", "text", "lang"]].itertuples(index=False, name=None))
    profiles = _learned(rows)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in queries.op7_language_id(spark, SF).collect()}
    assert got == {d: _predicted(t, profiles) for d, t, _ in rows}


def test_the_first_stage_by_its_own_rule(spark):
    """Rows stay that reach the bound of their language and length, worked out again from the fitting rows."""
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    rows = list(documents(SF.replace("0.001", "0.01"))[["doc_id", "text", "lang"]].itertuples(index=False, name=None))
    profiles = _learned(rows)
    found = {d: _predicted(t, profiles) for d, t, _ in rows}
    scores: dict = {}
    for d, text, lang in rows:
        if text is not None and lang is not None and zlib.crc32(str(d).encode()) % 5 and found[d][0] == lang:
            for key in ((lang, len(text).bit_length()), (lang, None)):
                scores.setdefault(key, []).append(found[d][1])
    low = {k: language_id.MARGIN * sorted(v)[max(0, -int(-language_id.QUANTILE * len(v) // 1) - 1)] for k, v in scores.items() if k[1] is None or len(v) >= language_id.LEAST_ROWS}
    kept = {d for d, text, _ in rows if found[d][0] != "und" and found[d][1] >= low.get((found[d][0], len(text).bit_length()), low.get((found[d][0], None), 0.0))}
    assert {r["doc_id"] for r in language_id.recognised(docs).select("doc_id").collect()} == kept and len(kept) > 900


def test_labels_that_name_no_languages(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 3)
    docs = spark.createDataFrame([(k, "some text", f"l{k}") for k in range(1, 30)], "doc_id bigint, text string, lang string")
    with pytest.raises(ValueError, match="does not name languages"):
        language_id.language_id(docs)


def test_all_labelled_rows_are_learned_from(spark, monkeypatch):
    """Profiles and bounds of languages with thousands of rows are those of all their rows, also if tasks hand counts on early."""
    monkeypatch.setattr(language_id, "COUNT_CHARS", 2000, raising=False)
    monkeypatch.setattr(language_id, "KEPT_NGRAMS", 500, raising=False)
    rows = [(k, words(k, 3 + k % 3) + (" the" if k % 2 else " les"), "fr" if k % 2 == 0 else "en") for k in range(1, 12_001)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    labelled = docs.where(~language_id.held_out(F.col("doc_id")))
    profiles = _learned(rows)
    assert all(sum(lang == r[2] and zlib.crc32(str(r[0]).encode()) % 5 > 0 for r in rows) > 4000 for lang in profiles)
    plain = Profiles.of({lang: [_code(g) for g in grams] for lang, grams in profiles.items()})
    got = language_id.fit(labelled)
    assert got.langs == plain.langs and (got.codes == plain.codes).all() and (got.ranks == plain.ranks).all()
    scores: dict = {}
    for d, text, lang in rows:
        own, score = plain.predict(text)
        if zlib.crc32(str(d).encode()) % 5 and own == lang:
            for key in ((lang, len(text).bit_length()), (lang, None)):
                scores.setdefault(key, []).append(score)
    low = {k: language_id.MARGIN * sorted(v)[-int(-language_id.QUANTILE * len(v) // 1) - 1] for k, v in scores.items() if k[1] is None or len(v) >= language_id.LEAST_ROWS}
    assert language_id.score_bounds(language_id.fitting_rows(labelled), plain) == low
