"""Copies of a document don't make its secrets examples, and no generic span is lost."""

from __future__ import annotations

import hashlib
import time
from collections import defaultdict

from pitchfold.llm import secret_scan

from .helpers import SF

OWN, WIDE, TWO = "Zq8Rt2Lm5Xc9Vb3Nk7Pw1Ys4Hd6", "Aa1Bb2Cc3Dd4Ee5Ff6Gg7Hh8Ii9", "q8rt2lm5xc9vb3nk7pw1ys4hd6j0"


def test_copies_of_one_owner_stay_live(spark):
    rows = [(k, f"see {OWN} here", "a") for k in range(40)] + [(100 + k, f"{k} {OWN}", "a") for k in range(5)]
    rows += [(200 + k, f"{WIDE} as an example", f"s{k}") for k in range(6)] + [(300, f"key {TWO}", "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    scanned = secret_scan.secret_scan(docs)
    got = {r["doc_id"]: r for r in secret_scan.digest(scanned).collect()}
    assert all(got[k]["spans"] == f"generic:4:{4 + len(OWN)}" and got[k]["n_live"] == 1 for k in range(40))
    first = scanned.where("doc_id = 0").first()["found"][0]
    assert (first["n_owners"], first["n_repos"], first["live"]) == (1, 6, True)
    assert got[200]["generic_examples"] == got[200]["spans"] == f"generic:0:{len(WIDE)}" and (got[200]["n_live"], got[200]["n_example"]) == (0, 1)
    assert got[300]["spans"] == f"generic:4:{4 + len(TWO)}"


def test_long_names_are_not_generic():
    for text in ("articles/2021/the-long-title-of-a-blog-post", "internationalisation-of-everything", "INTERNATIONALISATION/OF/everything"):
        assert not secret_scan.candidates(text)


def test_ownership_of_a_whole_table_by_plain_counts(spark):
    """Owners, repositories and class of every span of sf0.01, counted again without Spark."""
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    rows = docs.select("doc_id", "text", "source").collect()
    owners, repos, found = defaultdict(set), defaultdict(set), {}
    for d, text, source in rows:
        text = text or ""
        found[d] = [(c["start"], c["kind"], c["end"], text[c["start"] : c["end"]] if c["kind"] else secret_scan.ASSIGN.match(text[c["start"] : c["end"]])[2]) for c in secret_scan.candidates(text)]
        for *_, value in found[d]:
            owners[value].add(source)
            repos[value].add(hashlib.md5(text.encode()).hexdigest())
    assert sum(map(len, found.values())) > 20
    for r in secret_scan.secret_scan(docs).collect():
        got = [tuple(x) for x in r["found"]]
        assert got == sorted((s, k, e, len(owners[v]), len(repos[v]), len(owners[v]) <= 2) for s, k, e, v in found[r["doc_id"]])


def test_many_tokens_and_spans_in_one_text():
    """Overlaps with base spans are found in n log n steps; before, a text of this size took minutes."""
    text = "token: abcdef123456 Zq8Rt2Lm5Xc9Vb3Nk7Pw1Ys4Hd6 token=Zq8Rt2Lm5Xc9Vb3Nk7Pw1Ys4Hd6 " * 20_000
    began = time.process_time()
    found = secret_scan.candidates(text)
    assert time.process_time() - began < 20
    assert sum(c["kind"] == 0 for c in found) == 40_000 and sum(c["kind"] == 3 for c in found) == 20_000


def test_a_value_of_most_documents_is_split(spark):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.shuffle.partitions": "6", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "20k", "spark.sql.files.openCostInBytes": "1k"}
    before = {k: spark.conf.get(k, None) for k in conf}
    rows = [(k, f"key {WIDE}" if k % 10 else f"token: value{k}abc", f"s{k % 50}") for k in range(20_000)]
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        found = secret_scan.secret_scan(spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(16))
        assert all(len(r["found"]) == 1 for r in found.collect())
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
