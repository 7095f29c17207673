"""Every operator takes nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import public_tokenizers
import pytest

import corpus_pipeline
from pitchfold.llm import exact_dedup, html_extract, imatch, jaccard_join, language_id, license_scan, mixing, periodic_runs, secret_scan, token_codes, viterbi_pieces

from .helpers import awkward, awkward_rows, empty

OPERATORS = {
    "op1": secret_scan.secret_scan,
    "op2": license_scan.license_scan,
    "op4": mixing.mix_documents,
    "op5": lambda d: token_codes.encode_documents(d, public_tokenizers.path("byte_bpe_50k.json")),
    "op6": jaccard_join.jaccard_classes,
    "op7": language_id.language_id,
    "op8": lambda d: viterbi_pieces.digest_documents(d, public_tokenizers.path("piece_bpe_32k.model")),
    "op9": exact_dedup.exact_dedup,
    "op10": imatch.fingerprints,
    "op11": lambda d: periodic_runs.digest(periodic_runs.periodic_runs(d, edit=periodic_runs.repeat_from)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(spark, name):
    got = [r["doc_id"] for r in OPERATORS[name](awkward(spark)).select("doc_id").collect()]
    assert sorted(got, key=repr) == sorted((r[0] for r in awkward_rows()), key=repr)
    assert OPERATORS[name](empty(spark)).count() == 0


def test_pages(spark):
    rows = [(1, None, None), (2, "", ""), (None, "http://a.b/c", "<p>x"), (3, "HTTP://A.B:80/c", "<p>x</p>" * 20_000), (3, "nonsense", "<<<>>> & &amp; &#x41; <p"), (3, "nonsense", "<<<>>> & &amp; &#x41; <p")]
    names = ("host", "path", "n", "m", "blocks", "noise")
    pages = spark.createDataFrame([(*r, *names) for r in rows], "page_id bigint, url string, html string, " + ", ".join(f"{c} string" for c in names))
    got = html_extract.main_text(pages).collect()
    assert sorted((r["page_id"] or 0 for r in got)) == [0, 1, 2, 3, 3, 3]
    assert {r["text"] for r in got if r["page_id"] in (1, 2)} == {""}
    assert html_extract.main_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    docs = awkward(spark)
    got = run(spark, docs, "")
    if stage != corpus_pipeline.STAGES[-1][0]:
        assert got.columns == docs.columns and got.dtypes == docs.dtypes
    assert got.count() > 0
    got = run(spark, empty(spark), "")
    assert got.count() == 0
