"""Exact dedup, the Jaccard join and fingerprints against plain loops."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pitchfold.llm import exact_dedup, imatch, jaccard_join, queries
from pitchfold.llm.components import components

from .helpers import SF, documents, rows_of, words

LOWER = str.maketrans(exact_dedup.UPPER, exact_dedup.LOWER)


@pytest.mark.parametrize("content_hash", [exact_dedup.md5_128, lambda text: F.lit(b"same")])
def test_exact_even_when_hashes_collide(spark, content_hash):
    docs = documents()
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(spark.read.parquet(f"{SF}/documents.parquet"), content_hash=content_hash).collect()}
    groups = defaultdict(list)
    for d, t in docs[["doc_id", "text"]].itertuples(index=False):
        groups[(t or "").translate(LOWER)].append(d)
    assert len(got) == len(docs)
    for text, ids in groups.items():
        for d in ids:
            assert tuple(got[d]) == (d, max(ids), len(ids), d == max(ids), hashlib.sha256(text.encode()).hexdigest())


def test_only_ascii_letters_fold(spark):
    docs = spark.createDataFrame([(1, "ABC É"), (2, "abc É"), (3, "abc é"), (4, None), (5, ""), (6, "İ"), (7, "i̇")], "doc_id bigint, text string")
    assert {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_dedup(docs).collect()} == {1: 2, 2: 2, 3: 3, 4: 5, 5: 5, 6: 6, 7: 7}
    assert sorted(r["doc_id"] for r in exact_dedup.kept_documents(docs).collect()) == [2, 3, 5, 6, 7]


def _sets(texts: dict[int, str]) -> dict[int, frozenset]:
    out = {}
    for d, t in texts.items():
        w = re.findall(r"\w+", (t or "").lower())
        k = min(5, len(w))
        out[d] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()
    return out


def _classes(texts: dict[int, str], threshold: float = 0.8) -> dict[int, tuple[int, int, int]]:
    """doc_id: class, links, representative; over all pairs of distinct sets."""
    sets = _sets(texts)
    first: dict[frozenset, int] = {}
    for d in sorted(sets):
        first.setdefault(sets[d], d)
    parent, links = {d: d for d in first.values()}, Counter()

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    nodes = sorted(first.values())
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both >= threshold * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (root(first[s]), links[first[s]], first[s]) for d, s in sets.items()}


def _near_copies() -> dict[int, str]:
    rng = random.Random(5)
    texts, k = {}, 0
    for base in range(40):
        w = words(base, rng.choice([8, 30, 120, 600])).split()
        for _ in range(rng.choice([1, 2, 5, 30])):
            own = list(w)
            for _ in range(int(len(w) * rng.choice([0, 0.005, 0.01, 0.02, 0.04, 0.08]))):
                own[rng.randrange(len(own))] = words(rng.random(), 1)
            texts[k] = " ".join(own)
            k += 1
    ids = list(range(k))
    rng.shuffle(ids)
    return dict(zip(ids, texts.values()))


def _join(spark, texts: dict[int, str], **options):
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(5)
    return {r["doc_id"]: (r["class_id"], r["n_links"], r["copy_of"]) for r in jaccard_join.jaccard_classes(docs, **options).collect()}


def test_classes_and_links_of_near_copies(spark):
    texts = _near_copies()
    expected = _classes(texts)
    assert sum(v[1] > 0 for v in expected.values()) > 100
    assert _join(spark, texts) == expected


def test_blocks_of_large_classes(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_MEMBERS", 7)
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 500)
    monkeypatch.setattr(jaccard_join, "SLICE", 3)
    texts = _near_copies()
    assert _join(spark, texts) == _classes(texts)


def test_every_document(spark):
    texts = dict(documents()[["doc_id", "text"]].itertuples(index=False))
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["copy_of"]) for r in queries.op6_jaccard_join(spark, SF).collect()}
    assert got == _classes(texts)


def test_prefixes_reach_the_target_recall():
    for threshold in (0.8, 0.9, 0.95):
        d = jaccard_join.prefix_length(threshold, jaccard_join.RECALL)
        assert 1 - (1 - threshold**d) ** jaccard_join.TREES >= jaccard_join.RECALL
        assert d == jaccard_join.DEPTH or 1 - (1 - threshold ** (d + 1)) ** jaccard_join.TREES < jaccard_join.RECALL


def test_prefixes_are_shortened_as_the_links_found_ask(spark):
    links = lambda near, far: spark.createDataFrame([(near,)] * 2000 + [(far,)] * 2000, "s double")
    least = jaccard_join.prefix_length(0.8, 0.9995)
    assert least == 4
    assert jaccard_join.shortened(links(0.8, 0.99), 0.8, 0.9995) == least
    assert jaccard_join.shortened(links(0.86, 0.95), 0.8, 0.9995) == 6  # no link is as low as the threshold
    assert jaccard_join.shortened(links(0.95, 0.99), 0.8, 0.9995) == least  # none near the threshold tells
    assert jaccard_join.shortened(links(0.8, 0.99), 0.8, 0.9) == jaccard_join.DEPTH
    for s, d in ((0.8, 8), (0.85, 5), (0.9, 8)):
        assert abs(jaccard_join.chance(s, d) - (1 - (1 - s**d) ** 16)) < 1e-12


def test_differences_to_a_leader_give_all_links():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
    sets = []
    for _ in range(60):
        own = base[rng.random(len(base)) < rng.choice([0.5, 0.85, 0.9, 0.95, 0.99, 1])]
        sets.append(np.unique(np.concatenate([own, rng.integers(0, 2**63, rng.integers(0, 60)).astype(np.uint64)])))
    led = sets[7]
    got = jaccard_join.link_matrix(np.array([len(s) for s in sets]), [np.setxor1d(s, led) for s in sets], 0.8)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            both = len(np.intersect1d(a, b))
            assert got[i, j] == (i != j and both >= 0.8 * (len(a) + len(b) - both))


def test_rows_that_repeat_an_id_are_joined_each(spark):
    """Twenty copies of each of two texts, of which one each has the same id."""
    one, two = words(1, 200).split(), words(2, 200).split()
    rows = []
    for k in range(20):
        for base, w in ((100, one), (200, two)):
            own = list(w)
            own[10 * k % 200] = f"other{k}"
            rows.append((base + k, " ".join(own)))
    rows = [(7 if d in (105, 205) else d, t) for d, t in rows]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id bigint, text string").repartition(4)
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join.jaccard_classes(docs).collect())
    # both classes have the id 7, so both are named 7; each text has the links of its own class
    assert {c for _, c, _ in got} == {7} and {n for _, _, n in got} == {19} and len(got) == 43
    kept = [(r["doc_id"], r["text"].split()[-1]) for r in jaccard_join.one_of_each_class(docs).collect()]
    assert sorted(kept) == sorted([(7, one[-1]), (7, two[-1])])


def test_one_of_each_class_stays(spark):
    texts = _near_copies()
    docs = spark.createDataFrame([(d, t, 1) for d, t in texts.items()], "doc_id bigint, text string, other int")
    kept = jaccard_join.one_of_each_class(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {c for c, _, _ in _classes(texts).values()}


def test_components_of_a_long_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(1).shuffle(order)
    links = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001)], "a bigint, b bigint")
    got = dict(components(links).collect())
    assert got == {**{k: 0 for k in range(n)}, 1000: 1000, 1001: 1000}


class Plain:
    """Fingerprints and likeness by their definition, a term and a subset at a time."""

    def __init__(self, lexicon: list[str]):
        self.lexicon = set(lexicon)

    @staticmethod
    def mix(x: int) -> int:
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64
        return x ^ (x >> 31)

    def fingerprint(self, text: str) -> str:
        own = sorted({t for t in re.findall(r"\w+", text.lower())} & self.lexicon)
        out = f"{len(own):06x}"
        for k, rate in enumerate((2, 8, 32, 128, 512, 2048)):
            for j in range(10 * k + 1, 10 * k + 11):
                codes = [xxhash.xxh64_intdigest(t, 0) for t in own]
                inside = [c for c in codes if self.mix((c + j * 0x9E3779B97F4A7C15) % 2**64) % rate == 0]
                out += xxhash.xxh32_hexdigest(b"".join(c.to_bytes(8, "little") for c in inside)) if inside else "--------"
        return out

    @staticmethod
    def likeness(a: str, b: str) -> float:
        if a == b:
            return 1.0
        most = max(int(a[:6], 16), int(b[:6], 16))
        pairs = [[(a[6 + 80 * k + 8 * j :][:8], b[6 + 80 * k + 8 * j :][:8]) for j in range(10)] for k in range(6)]
        filled = [[p for p in x if p != ("--------", "--------")] for x in pairs]
        counted: list = []
        for rate, x in zip((2048, 512, 128, 32, 8, 2), filled[::-1]):
            if rate * 2 < most and counted:
                break
            counted += x
        return sum(x == y for x, y in counted) / len(counted) if counted else 0.0


def test_equal_fingerprints_are_alike():
    printer = imatch.Fingerprinter(["alpha", "beta"])
    none = printer.fingerprint("nothing of these")
    assert imatch.likeness(none, none) == 1.0 and imatch.likeness(none, printer.fingerprint("alpha")) == 0.0


def test_ids_must_be_numbers(spark):
    with pytest.raises(TypeError):
        imatch.fingerprints(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_ranges_hold_all_and_stand_alone(spark):
    """Very uneven ids, repeated and null ones: each row once, in order, each range in a task of its own."""
    ids = [*range(50), *range(10**15, 10**15 + 50), -5, -5, None, None]
    docs = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "doc_id bigint, text string").repartition(3)
    got = imatch._in_order(docs).withColumn("task", F.spark_partition_id()).collect()
    own = [r for r in got if not r["extra"]]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in own) == sorted((i is None, i or 0) for i in ids)
    order = sorted(own, key=lambda r: r["bucket"])
    assert [r["doc_id"] for r in order if r["doc_id"] is not None] == sorted((i for i in ids if i is not None), reverse=True)
    assert all(len({r["bucket"] for r in got if r["task"] == t}) == 1 for t in {r["task"] for r in got})


def test_fingerprints_of_every_document(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in imatch.fingerprints(docs.repartition(6)).collect()}
    rows = sorted(((d, t or "") for d, t in documents()[["doc_id", "text"]].itertuples(index=False)), reverse=True)
    df = Counter(t for _, text in rows for t in set(re.findall(r"\w+", text.lower())))
    band = sorted(t for t, n in df.items() if max(2, imatch.MIN_SHARE * len(rows)) <= n <= imatch.MAX_SHARE * len(rows))
    assert imatch.lexicon(docs) == band
    printer = Plain(band)
    by_text: dict[str, str] = {}
    for k, (d, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        third = len(text) // 3
        changed = text[: len(text) - third] + following[:third]
        r = got[d]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["fingerprint"] == printer.fingerprint(text) and r["edited_fingerprint"] == printer.fingerprint(changed)
        assert r["near_edited"] == printer.likeness(r["fingerprint"], r["edited_fingerprint"])
        assert r["near_next"] == printer.likeness(r["fingerprint"], printer.fingerprint(following))
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
    assert len(got) == len(rows)


def test_edits_are_nearer_than_other_documents(spark):
    got = queries.op10_imatch(spark, SF.replace("0.001", "0.01")).where("n_chars >= 300").select("near_edited", "near_next").toPandas()
    assert (got["near_edited"] > got["near_next"]).mean() > 0.8
    assert got["near_edited"].mean() > got["near_next"].mean() + 0.2
    assert np.isfinite(got.to_numpy()).all() and got.to_numpy().min() >= 0 and got.to_numpy().max() <= 1


def test_ids_and_one_document(spark):
    one = spark.createDataFrame([(7, "alone in here")], "doc_id bigint, text string")
    r = imatch.fingerprints(one).first()
    assert (r["doc_id"], r["n_chars"]) == (7, 13) and r["edited_sha256"] == hashlib.sha256(b"alone in alon").hexdigest()
    assert rows_of(imatch.fingerprints(one.limit(0))) == []


@pytest.mark.parametrize("kind", ["near", "two", "wide"])
def test_links_of_a_class_of_thousands(spark, monkeypatch, kind):
    """Members near one text, around two texts, and of very uneven sizes: every count as by comparing all."""
    rng = np.random.default_rng({"near": 1, "two": 2, "wide": 3}[kind])
    base = np.arange(1, 400, dtype=np.uint64)
    led = np.concatenate([base[:-30], np.arange(10_000, 10_030, dtype=np.uint64)])  # the leader is none of the typical ones
    sets = [led]
    for k in range(2999):
        core = base if kind != "two" or k % 2 else np.concatenate([base[:-45], np.arange(5000, 5045, dtype=np.uint64)])
        cut = int(rng.integers(0, 30 if kind != "wide" else 90))
        kept = rng.choice(core, len(core) - cut, replace=False)
        sets.append(np.sort(np.concatenate([kept, rng.integers(20_000, 20_400, int(rng.integers(0, 20))).astype(np.uint64)])))
    sets = [np.unique(x) for x in sets]
    sizes = np.array([len(x) for x in sets])
    features = [np.setxor1d(x, led) for x in sets]
    expected = jaccard_join.link_matrix(sizes, features, 0.8).sum(1)
    rows = [(7, k, int(sizes[k]), features[k].tobytes()) for k in range(3000)] + [(8, 9000 + k, int(sizes[k]), features[k].tobytes()) for k in range(3)]
    members = spark.createDataFrame(rows, "class bigint, node bigint, n int, features binary").repartition(5)
    monkeypatch.setattr(jaccard_join, "BLOCK_MEMBERS", 500)
    got = {r["node"]: r["links"] for r in jaccard_join._links_in_classes(members, 0.8).collect()}
    assert [got[k] for k in range(3000)] == expected.tolist() and expected.max() > 300 and len(got) == 3003
    if kind == "near":
        large = jaccard_join._links_in_large_classes(members.where("class = 7").withColumn("m", F.lit(3000).cast("bigint")), 0.8)
        assert large.count() == 3000
        near = [x for x in sets if len(np.setxor1d(x, base)) * 9 <= len(x)]
        assert len(near) > 2500  # most are counted without being compared
