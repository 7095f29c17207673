"""Noise and languages that were not learned are rejected; short clean texts stay."""

from __future__ import annotations

import base64
import random
import string

from pitchfold.llm import language_id

from .helpers import SF

POLISH = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa."
GREEK = "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα, a"


def test_noise_and_unlearned_languages_go(spark):
    rng = random.Random(3)
    junk = ["".join(rng.choice(string.ascii_letters + " ") for _ in range(n)) for n in (100, 400, 3000)]
    junk += [base64.b64encode(rng.randbytes(n)).decode() for n in (100, 400, 3000)] + [POLISH, POLISH * 5, GREEK]
    clean = ["the house is on the hill", "This is a short clean text.", "This is the history of the town and of those who lived there."]
    rows = [(10**9 + k, t, None, "x", len(t)) for k, t in enumerate(junk + clean)]
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    both = docs.unionByName(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    kept = language_id.recognised(both).select("doc_id", "text").collect()
    assert sorted(r["text"] for r in kept if r["doc_id"] >= 10**9) == sorted(clean)
    assert sum(r["doc_id"] < 10**9 for r in kept) >= 0.99 * docs.count()
