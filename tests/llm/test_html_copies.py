"""Pages that many rows of a host repeat keep their main text."""

from __future__ import annotations

from pitchfold.llm import html_extract

from .helpers import words


def test_copies_of_a_page_keep_their_text(spark):
    made = [("one", 0)] * 40 + [("three", 1 + k % 3) for k in range(90)]
    page = lambda k: f"<html><body><div class='z1'><p>{words(k, 30)}</p></div></body></html>"
    pages = spark.createDataFrame([(i, f"http://{h}.example/", page(k)) for i, (h, k) in enumerate(made)], "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.main_text(pages).collect()}
    assert got == {i: words(k, 30) for i, (_, k) in enumerate(made)}
