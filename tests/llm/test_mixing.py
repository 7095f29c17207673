"""The mix meets its targets, block by block, and agrees with a plain recount."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pitchfold.llm import mixing, queries

from .helpers import SF, documents, rows_of, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_contract(spark):
    docs = documents()
    rows = queries.op4_mix_sources(spark, SF).collect()
    sizes = {d: len(WORD.findall(t or "")) for d, t in docs[["doc_id", "text"]].itertuples(index=False)}
    by_source: Counter = Counter()
    for d, s in docs[["doc_id", "source"]].itertuples(index=False):
        by_source[s] += sizes[d]
    names = sorted(s for s in by_source if s is not None) + [None] * (None in by_source)
    # the waterfall again, a step at a time
    weights = {s: 1 + i % 3 for i, s in enumerate(names)}
    target: dict = {}
    rest, free = sum(by_source.values()), set(names)
    while True:
        share = {s: rest * weights[s] / sum(weights[t] for t in free) for s in free}
        over = [s for s in free if share[s] > 3 * by_source[s]]
        if not over:
            break
        for s in over:
            target[s] = 3 * by_source[s]
            rest -= target[s]
            free.remove(s)
    target |= share
    taken: Counter = Counter()
    source = dict(docs[["doc_id", "source"]].itertuples(index=False))
    assert len(rows) == len(docs)
    for r in rows:
        s = source[r["doc_id"]]
        assert r["size"] == sizes[r["doc_id"]] and r["source_size"] == by_source[s]
        assert abs(r["target"] - target[s]) < 1e-6 * max(1, target[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in names:
        assert taken[s] == round(target[s])
    again = mixing.mix_documents(spark.read.parquet(f"{SF}/documents.parquet").repartition(7))
    assert rows_of(again.select("doc_id", "taken")) == sorted(((r["doc_id"], r["taken"]) for r in rows), key=repr)


def test_permutation_is_one_to_one():
    for n in (1, 2, 3, 5, 64, 1000, 4097):
        index = np.arange(n)
        for key in (0, 12345):
            out = mixing.permuted(index, np.full(n, n), np.full(n, key, np.uint64))
            assert sorted(out) == list(range(n))
    assert (mixing.permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, 1, np.uint64)) != np.arange(1000)).sum() > 900


def test_shards_hold_their_quota():
    sources = mixing.plan_sources({"a": 640_000, "b": 64_000, "c": 100, None: 0})
    groups, shards = 3, 5
    total = np.zeros(len(sources), int)
    for g in range(groups):
        for count, first in mixing.shard_counts(sources, g, groups, shards, seed=3):
            assert (first >= total).all() if g == 0 else True
            total += count
    assert list(total) == [s.quota for s in sources]


def test_each_block_is_taken_an_even_number_of_times(spark):
    docs = spark.createDataFrame([(k, words(k, 50 + k), "ab"[k % 2]) for k in range(60)], "doc_id bigint, text string, source string")
    rows = mixing.sized(docs).selectExpr("*", "doc_id AS uid")
    mix = mixing.plan_mix(rows, block_words=16)
    uses = defaultdict(Counter)
    for s, block in mix.slots.select("s", "block").collect():
        uses[s][block] += 1
    for s, source in enumerate(mix.sources):
        assert sum(uses[s].values()) == source.quota
        assert max(uses[s].values()) <= min(3, -(-source.quota // source.blocks))
        assert set(uses[s]) <= set(range(source.blocks))
    held = mix.segments.groupBy("uid").sum("words").collect()
    assert {u: n for u, n in held} == {k: 50 + k for k in range(60)}


def test_mixed_texts_are_runs_of_their_document(spark):
    docs = spark.createDataFrame([(k, words(k, 40 + 5 * k), "abc"[k % 3], 0) for k in range(40)], "doc_id bigint, text string, source string, n_chars int")
    original = {r["doc_id"]: r["text"].split() for r in docs.collect()}
    counted: Counter = Counter()
    for r in mixing.mixed_documents(docs).collect():
        assert r["n_chars"] == len(r["text"])
        for part in r["text"].split("\n"):
            w, whole = part.split(), original[r["doc_id"]]
            at = whole.index(w[0])
            assert whole[at : at + len(w)] == w
        counted[r["doc_id"]] += len(r["text"].split())
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix_documents(docs).collect()}
    assert {k: v for k, v in taken.items() if v} == dict(counted)


def test_word_counts():
    rng = np.random.default_rng(1)
    these = ["".join(rng.choice(list("ab \t\n\x0b\x0c\r\x1f é𝄞\x85"), rng.integers(30))) for _ in range(500)] + ["", None]
    assert mixing.word_counts(pa.array(these)).tolist() == [len(WORD.findall(t or "")) for t in these]
    assert mixing.word_counts(pa.array([], pa.string())).tolist() == []


def test_taken_is_that_of_the_permutations(spark):
    """Words of each document, from the order of blocks that the permutations give and the target."""
    made = [(k, words(k, (k * 37) % 300), f"s{k % 7}") for k in range(90)] + [(1000, "a b c d e f g", "tiny"), (1001, "x", "z-one")]
    docs = spark.createDataFrame(made, "doc_id bigint, text string, source string").repartition(3)
    block = 16
    rows = mixing.sized(docs).selectExpr("*", "doc_id AS uid")
    mix = mixing.plan_mix(rows, block_words=block)
    held = defaultdict(list)
    for s, b, at, uid, first, n in mix.segments.select("s", "block", "at", "uid", "first", "words").collect():
        held[s, b] += [(at + k, uid, first + k) for k in range(n)]
    for s, source in enumerate(mix.sources):  # blocks are full but for the last, and hold each word once
        sizes = [len(held[s, b]) for b in range(source.blocks)]
        assert sum(sizes) == source.size and all(n == block for n in sizes[:-1])
        assert [a for b in range(source.blocks) for a, _, _ in sorted(held[s, b])] == [k for n in sizes for k in range(n)]
    expected: Counter = Counter()
    for s, source in enumerate(mix.sources):
        left, epoch = round(source.target), 0
        while left:
            key = mixing.epoch_key(0, np.array([epoch]), len(mix.sources), np.array([s]))
            for k in range(source.blocks):
                b = int(mixing.permuted(np.array([k]), np.array([source.blocks]), key)[0])
                for _, uid, _ in sorted(held[s, b])[:left]:
                    expected[uid] += 1
                left -= min(left, len(held[s, b]))
                if not left:
                    break
            epoch += 1
    got = {r["doc_id"]: r["taken"] for r in mixing.mix_documents(docs, block_words=block).collect()}
    assert {d: n for d, n in got.items() if n} == dict(expected)
    for r in mixing.mix_documents(docs, block_words=block).collect():
        assert r["taken"] <= 3 * r["size"]


def test_the_draws_decide_where_words_stand(spark):
    docs = spark.createDataFrame([(k, words(k, 50 + k), f"s{k % 3}") for k in range(60)], "doc_id bigint, text string, source string")
    one, two = ({r["doc_id"]: r for r in mixing.mix_documents(docs, block_words=8, shard_slots=n).collect()} for n in (16, 64))
    assert {d: r["taken"] for d, r in one.items()} == {d: r["taken"] for d, r in two.items()}
    assert sum((one[d]["shard"], one[d]["slot"]) != (two[d]["shard"], two[d]["slot"]) for d in one) > 40
    other = {r["doc_id"]: r for r in mixing.mix_documents(docs, block_words=8, shard_slots=16, seed=1).collect()}
    assert sum(one[d]["taken"] != other[d]["taken"] for d in one) > 10


def test_the_stream_holds_the_words_that_documents_give(spark):
    made = [(k, " ".join(f"{k}-{i}" for i in range(20 + 3 * k)), "abc"[k % 3], 0) for k in range(50)]
    docs = spark.createDataFrame(made, "doc_id bigint, text string, source string, n_chars int")
    stream = mixing.mixed_blocks(docs, block_words=16, shard_slots=8).collect()
    counted: Counter = Counter(int(w.split("-")[0]) for r in stream for w in r["text"].split())
    rows = {r["doc_id"]: r for r in mixing.mix_documents(docs, block_words=16, shard_slots=8).collect()}
    assert counted == Counter({d: r["taken"] for d, r in rows.items() if r["taken"]})
    assert len({(r["shard"], r["slot"]) for r in stream}) == len(stream)
    assert all(len(r["text"].split()) <= 16 for r in stream)
    first: dict = {}
    shards: dict = defaultdict(set)
    for r in sorted(stream, key=lambda r: (r["shard"], r["slot"])):
        for w in r["text"].split():
            d = int(w.split("-")[0])
            assert r["source"] == "abc"[d % 3]
            first.setdefault(d, (r["shard"], r["slot"]))
            shards[d].add(r["shard"])
    assert all((r["shard"], r["slot"]) == first.get(d, (None, None)) and r["n_shards"] == len(shards[d]) for d, r in rows.items())
    order = [r["doc_id"] for r in mixing.mixed_documents(docs, block_words=16, shard_slots=8).coalesce(1).collect()]
    assert set(order) == set(first)


def test_shards_draw_as_a_multinomial_does():
    """Each shard's count of a source has the mean of its share, and varies as draws do."""
    sources = mixing.plan_sources({"a": 640_000, "b": 1_280_000, "c": 320_000})
    share = np.array([s.quota for s in sources]) / sum(s.quota for s in sources)
    counts = np.array([c for g in range(4) for c, _ in mixing.shard_counts(sources, g, 4, 50, seed=5)])
    size = counts.sum(1)
    assert (size.max() - size.min()) <= 2
    expected = np.sqrt(size.mean() * share * (1 - share))
    assert (np.abs(counts.mean(0) - size.mean() * share) < expected).all()
    assert (counts.std(0) > 0.7 * expected).all() and (counts.std(0) < 1.3 * expected).all()


def test_place_in_permutation():
    for n in (1, 2, 3, 5, 64, 1000, 4097):
        key = np.uint64(987654321 + n)
        order = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key, np.uint64))
        for k in {0, n // 2, n - 1}:
            assert mixing.place_in_permutation(int(order[k]), n, int(key)) == k


def test_small_sources_meet_their_targets(spark):
    made = [(1, "a b c d e f g", "x"), (2, "h i", "y"), (3, "j", "z"), (4, "k l m n", None), (5, None, "x")]
    docs = spark.createDataFrame(made, "doc_id bigint, text string, source string")
    got: Counter = Counter()
    target = {}
    for r in mixing.mix_documents(docs).collect():
        got[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 3 * r["size"]
    assert all(got[s] == round(t) for s, t in target.items()) and abs(sum(target.values()) - 14) < 1e-9


def test_sources_as_a_table_are_planned_alike(spark):
    rng = np.random.default_rng(3)
    sizes = {f"s{k}": int(rng.integers(0, 4000) if k % 5 else rng.integers(0, 40)) for k in range(70)} | {None: 77, "Ä": 500, "": 9}
    for weights in (None, {n: float(rng.integers(1, 9)) for n in sizes}):
        expected = mixing.plan_sources(sizes, weights, 16, seed=5)
        table = mixing.source_table(spark.createDataFrame([(n, v, 3 * v % 11 + 1) for n, v in sizes.items()], "source string, size bigint, n bigint"), weights, 5, 16)
        rows = {r["s"]: r for r in table.collect()}
        before = 0
        for i, s in enumerate(expected):
            r = rows[i]
            assert (r["name"], r["source_size"], r["blocks"], r["quota"], r["last"], r["before"]) == (s.name, s.size, s.blocks, s.quota, s.last, before)
            assert abs(r["target"] - s.target) < 1e-6 * max(1.0, s.target)
            before += s.quota


def test_more_sources_than_the_driver_takes(spark):
    """Beyond the bound sources are a table: the same targets to the word, each block evenly often, no slot twice."""
    made = [(k, words(k, (k * 37) % 300), None if k % 50 == 7 else f"s{(k * k) % 23}", 0) for k in range(400)]
    docs = spark.createDataFrame(made, "doc_id bigint, text string, source string, n_chars int").repartition(3)
    few = {r["doc_id"]: r for r in mixing.mix_documents(docs, block_words=16).collect()}
    rows = mixing.mix_documents(docs, block_words=16, most_sources=5).collect()
    taken, source = Counter(), {d: s for d, _, s, _ in made}
    for r in rows:
        one = few[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (one["size"], one["source_size"]) and abs(r["target"] - one["target"]) < 1e-6 * max(1, one["target"])
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["shard"] is None) == (r["taken"] == 0)
        taken[source[r["doc_id"]]] += r["taken"]
    targets = {source[r["doc_id"]]: r["target"] for r in rows}
    assert len(rows) == 400 and all(taken[s] == round(t) for s, t in targets.items())
    assert {r["doc_id"]: r["taken"] for r in rows} == {d: r["taken"] for d, r in few.items()}  # which words are taken doesn't depend on where they go
    again = mixing.mix_documents(docs.repartition(9), block_words=16, most_sources=5)
    assert rows_of(again.select("doc_id", "taken", "shard", "slot")) == sorted(((r["doc_id"], r["taken"], r["shard"], r["slot"]) for r in rows), key=repr)
    sizes = mixing.sized(docs).selectExpr("*", "doc_id AS uid")
    slots = mixing.plan_mix(sizes, block_words=16, shard_slots=64, most_sources=5).slots.collect()
    assert len({(r["shard"], r["slot"]) for r in slots}) == len(slots) and max(Counter(r["shard"] for r in slots).values()) <= 64


def test_a_missing_weight_is_an_error(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, "c", "y")], "doc_id bigint, text string, source string")
    with pytest.raises(Exception, match="no weight"):
        mixing.mix_documents(docs, weights={"x": 1.0}, most_sources=0).collect()
    assert mixing.mix_documents(docs.limit(0), most_sources=0).count() == 0
