"""N-gram Jaccard self-join by a MinHash LSH forest with exact verification.

Texts are sets of word 5-shingles. Equal sets are one node, whatever ids the
texts have. A node has TREES labels of DEPTH MinHash values, and each tree is
the trie of its sorted labels: nodes that share a prefix of a label stand below
one trie node, their bucket. The search descends adaptively:

1. It begins with the longest prefixes. Each bucket's members are compared to
   its most connected member (a star, not all pairs).
2. The similarities of the links found tell how many links a prefix of any
   length would find (each found link stands for 1 / its chance to be found).
   The prefixes are shortened as far as the target recall asks, for the links
   near the threshold; with few of these, as far as a pair at the threshold does.
3. In the buckets of the shortened prefixes, again members of other classes than
   their bucket's leader are compared to it, and classes merge.
4. Buckets that still hold several classes are searched for links across these.

Every link is verified on whole texts. Where many members meet (steps 3 and 4,
and the count of links in a class), no pair becomes a row: members are dealt
into blocks, and a task compares two blocks by matrix products. What travels
there is a set's difference to its leader's set, from which the similarity of
any two members follows exactly: (A ^ L) ^ (B ^ L) = A ^ B.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, map_arrow, materialise, mix64, slices, texts
from .components import components

WORDS = 5
THRESHOLD = 0.8
TREES, DEPTH = 16, 8
#: Bytes of a label's value.
VALUE = 2
RECALL = 0.9995
#: Links from the threshold up to so much more tell the depth, if they are so many.
NEAR, LEAST_LINKS = 0.1, 1000
#: Standard deviations that an estimated similarity may lie below the threshold; a pair at the threshold lies lower once in 30,000.
SLACK = 4.0
#: Members and differing shingles of a block; a task compares two blocks.
BLOCK_MEMBERS, BLOCK_SHINGLES = 1024, 1 << 18
#: Members that are compared to their leader in one task.
SLICE = 512
_WORD = re.compile(r"\w+")
_U = np.uint64
_P = _U(0x100000001B3)
_P_INVERSE = _U(pow(0x100000001B3, -1, 1 << 64))
_powers = [np.ones(1, _U), np.ones(1, _U)]


def chance(similarity, depth: int):
    """The chance that a pair shares a prefix of ``depth`` values in some tree; of a number or a Column."""
    return 1 - (1 - similarity**depth) ** TREES


def prefix_length(threshold: float, recall: float) -> int:
    """The longest prefix with which a pair at the threshold meets with the target probability."""
    return next((d for d in range(DEPTH, 1, -1) if chance(threshold, d) >= recall), 1)


def shortened(links: DataFrame, threshold: float, recall: float) -> int:
    """The longest prefix that finds the target share of the links near the threshold, from links (s) that the longest prefixes found."""
    least = prefix_length(threshold, recall)
    depths = range(DEPTH, least, -1)
    near = links.where(F.col("s") < threshold + NEAR)
    found = near.agg(F.count(F.lit(1)).alias("n"), F.sum(1 / chance(F.col("s"), DEPTH)).alias("total"), *[F.sum(chance(F.col("s"), d) / chance(F.col("s"), DEPTH)).alias(f"d{d}") for d in depths]).first()
    if found["n"] < LEAST_LINKS:
        return least
    return next((d for d in depths if found[f"d{d}"] >= recall * found["total"]), least)


def _power_table(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << n.bit_length()
        for k, base in enumerate((_P, _P_INVERSE)):
            _powers[k] = np.cumprod(np.concatenate([np.ones(1, _U), np.full(size - 1, base, _U)]))
    return _powers


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word of the lower-cased text."""
    data = np.frombuffer((" ".join(_WORD.findall(text.lower())) + " ").encode("utf-8", "surrogatepass"), np.uint8)
    if len(data) == 1:
        return np.empty(0, _U)
    up, down = _power_table(len(data) + 1)
    ends = np.flatnonzero(data == 32)
    starts = np.append(0, ends[:-1] + 1)
    sums = np.append(_U(0), np.cumsum((data.astype(_U) + _U(1)) * up[: len(data)]))
    return mix64((sums[ends] - sums[starts]) * down[starts])


_PLACE = mix64(np.arange(1, 65, dtype=_U)) | _U(1)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words; a shorter text is one run, a text without words none."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(words, len(w))
    out = np.zeros(len(w) - k + 1, _U)
    for j in range(k):
        out += w[j : len(w) - k + 1 + j] * _PLACE[j]
    return np.unique(mix64(out + _U(k)))


_A = mix64(np.arange(101, 101 + TREES * DEPTH, dtype=_U)) | _U(1)
_B = mix64(np.arange(901, 901 + TREES * DEPTH, dtype=_U))


def signature(s: np.ndarray) -> np.ndarray:
    """TREES x DEPTH MinHash values of a non-empty set."""
    low = np.full(TREES * DEPTH, np.iinfo(np.uint64).max, _U)
    for start in range(0, len(s), 1024):
        part = s[start : start + 1024]
        low = np.minimum(low, (_A[:, None] * part[None, :] + _B[:, None]).min(1))
    return mix64(low)


def set_key(s: np.ndarray) -> bytes:
    """128 bits that equal sets share."""
    return np.array([s.sum(dtype=_U), (mix64(s) * _PLACE[0]).sum(dtype=_U) ^ _U(len(s))]).tobytes()


_NIBBLE = _U(4) * np.arange(16, dtype=_U)


def packed(sig: np.ndarray) -> np.ndarray:
    """Four bits of each value, sixteen to a long."""
    return ((sig.reshape(-1, 16) & _U(15)) << _NIBBLE).sum(1, dtype=_U).view(np.int64)


def _sign(batch: pa.RecordBatch) -> dict:
    keys, sizes, labels, sigs = [], [], [], []
    for text in texts(batch.column("text")):
        s = shingles(text)
        keys.append(set_key(s))
        sizes.append(len(s))
        sig = signature(s) if len(s) else None
        labels.append(None if sig is None else (sig >> _U(64 - 8 * VALUE)).astype(">u2").tobytes())
        sigs.append(None if sig is None else packed(sig))
    return {"doc_id": batch.column("doc_id"), "h": batch.column("h"), "key": pa.array(keys, pa.binary()), "n": pa.array(sizes, pa.int32()), "labels": pa.array(labels, pa.binary()), "sig": pa.array(sigs, pa.list_(pa.int64()))}


def _estimate(a: Column, b: Column) -> Column:
    """Similarity from two packed signatures: the share of equal nibbles, less the chance of 1 in 16."""
    apart = F.lit(0)
    for k in range(TREES * DEPTH // 16):
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111))
        apart = apart + F.bit_count(x)
    return 1 - apart / F.lit(TREES * DEPTH * 15 / 16)


def _floor(threshold: float) -> float:
    n = TREES * DEPTH
    match = threshold + (1 - threshold) / 16
    return threshold - SLACK * math.sqrt(match * (1 - match) / n) * 16 / 15


def _buckets(nodes: DataFrame, depth: int) -> DataFrame:
    """(t, p, g, node): members of the trie nodes of ``depth`` that g > 1 nodes stand below."""
    at = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.alias("t"), F.xxhash64(F.substring("labels", t * (DEPTH * VALUE) + 1, F.lit(depth * VALUE))).alias("p")))
    rows = nodes.select("node", F.explode(at).alias("at")).select("at.t", "at.p", "node")
    crowded = rows.groupBy("t", "p").agg(F.count(F.lit(1)).alias("g")).where("g > 1")
    return rows.join(crowded, ["t", "p"])


def _stars(members: DataFrame, nodes: DataFrame, classes: DataFrame | None, threshold: float) -> DataFrame:
    """(node, leader) of each bucket's members, and its most connected one, that are of different classes and may be linked."""
    mass = members.groupBy("node").agg(F.sum("g").alias("mass"))
    leaders = members.join(mass, "node").groupBy("t", "p").agg(F.max(F.struct("mass", "node")).alias("l")).select("t", "p", F.col("l.node").alias("leader"))
    pairs = members.join(leaders, ["t", "p"]).where("node <> leader").select("node", "leader").distinct()
    if classes is not None:
        own, other = classes.select(F.col("id").alias("node"), F.col("label").alias("own")), classes.select(F.col("id").alias("leader"), F.col("label").alias("other"))
        pairs = pairs.join(own, "node", "left").join(other, "leader", "left").where(F.coalesce("own", "node") != F.coalesce("other", "leader"))
    looks = nodes.select("node", "n", "sig")
    pairs = pairs.select("node", "leader").join(looks, "node").join(looks.withColumnsRenamed({"node": "leader", "n": "leader_n", "sig": "leader_sig"}), "leader")
    return pairs.where(_may_link("n", "sig", "leader_n", "leader_sig", threshold)).select("node", "leader")


def _may_link(n: str, sig: str, other_n: str, other_sig: str, threshold: float) -> Column:
    """Sizes allow the threshold, and signatures don't rule it out."""
    small, large = F.least(n, other_n), F.greatest(n, other_n)
    return (small >= F.lit(threshold) * large - 1e-9) & (_estimate(F.col(sig), F.col(other_sig)) >= _floor(threshold))


def _differences(members: DataFrame, node_texts: DataFrame, features: bool) -> DataFrame:
    """Members (node, leader, ...) with n, leader_n, apart (shingles that only one of the two has), and these themselves if asked for.

    A leader's text goes once to every SLICE of its members, not to each of them.
    """
    more = [c for c in members.columns if c not in ("node", "leader")]
    slices_of = members.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("slices"))
    dealt = members.join(slices_of, "leader").select("leader", F.pmod(F.xxhash64("node"), "slices").cast("int").alias("slice"), F.lit(1).alias("place"), "node", *more).join(node_texts, "node")
    first = slices_of.select("leader", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice")).join(node_texts.withColumnRenamed("node", "leader"), "leader")
    first = first.select("leader", "slice", F.lit(0).alias("place"), F.col("leader").alias("node"), *[F.lit(None).cast(members.schema[c].dataType).alias(c) for c in more], "text")
    rows = dealt.select("leader", "slice", "place", "node", *more, "text").unionByName(first).repartition("leader", "slice").sortWithinPartitions("leader", "slice", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        led = np.empty(0, _U)
        for batch in slices(batches):
            kept, n, leader_n, apart, xor = [], [], [], [], []
            for k, (place, text) in enumerate(zip(batch.column("place").to_pylist(), texts(batch.column("text")), strict=True)):
                own = shingles(text)
                if not place:
                    led = own
                    continue
                only = np.setxor1d(own, led, assume_unique=True)
                kept.append(k)
                n.append(len(own))
                leader_n.append(len(led))
                apart.append(len(only))
                xor.append(only.tobytes() if features else None)
            part = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_pydict({**{c: part.column(c) for c in ("node", "leader", *more)}, "n": pa.array(n, pa.int32()), "leader_n": pa.array(leader_n, pa.int32()), "apart": pa.array(apart, pa.int32()), "features": pa.array(xor, pa.binary())})

    fields = members.select("node", "leader", *more).schema
    for name, kind in (("n", "integer"), ("leader_n", "integer"), ("apart", "integer"), ("features", "binary")):
        fields = fields.add(name, kind)
    return rows.mapInArrow(run, fields)


def _verified(stars: DataFrame, node_texts: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b, s): the stars (node, leader) of similarity ``threshold`` or more."""
    found = _differences(stars, node_texts, features=False)
    both = (F.col("n") + F.col("leader_n") - F.col("apart")) / 2
    s = F.when(both > 0, both / (both + F.col("apart"))).otherwise(0.0)
    return found.select(F.col("node").alias("a"), F.col("leader").alias("b"), s.alias("s")).where(F.col("s") >= threshold - 1e-12)


def _in_blocks(members: DataFrame, group: list[str], weight: Column) -> DataFrame:
    """Deal each group's members (group, node, class, ...) into blocks, and every two blocks into one task as (group, i, j)."""
    more = [c for c in members.columns if c not in group]
    totals = members.groupBy(*group).agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_MEMBERS), F.ceil(F.sum(weight) / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    dealt = members.join(totals, group).withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, F.col("own")).alias("i"), F.greatest(j, F.col("own")).alias("j")))
    dealt = dealt.select(F.explode(pairs).alias("p_"), "own", *group, *more).select(F.struct(*group, "p_.i", "p_.j").alias("at"), "own", *more)
    return dealt.repartition("at").sortWithinPartitions("at")


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray, dict[str, list]]]:
    """Of each two blocks that meet: their group, which pairs of members are this task's, and the members' columns."""
    names: list[str] = []

    def rows() -> Iterator[tuple]:
        for batch in batches:
            names[:] = batch.schema.names
            yield from zip(*(batch.column(c).to_pylist() for c in names), strict=True)

    stream = rows()
    for at, group in groupby(stream, key=lambda r: tuple(r[0].values()) if isinstance(r[0], dict) else r[0]):
        columns = dict(zip(names, map(list, zip(*group, strict=True)), strict=True))
        where, own = columns["at"][0], np.array(columns["own"])
        here = own[:, None] != own[None, :] if where["i"] != where["j"] else ~np.eye(len(own), dtype=bool)
        yield where, here, columns


def _codes(values: list) -> np.ndarray:
    """A number for each value, in the order of the values."""
    place = {v: k for k, v in enumerate(sorted(set(values)))}
    return np.array([place[v] for v in values])


def link_matrix(sizes: np.ndarray, features: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which of a few sets are linked, from their sizes and their differences to one and the same set.

    Common features come from products of slices of the incidence matrix.
    """
    n = len(features)
    counts = np.array([len(f) for f in features], np.int64)
    _, column, held = np.unique(np.concatenate(features) if n else np.empty(0, _U), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), counts)
    shared = held[column] > 1
    row, column = row[shared], column[shared]
    order = np.argsort(column, kind="stable")
    row, column = row[order], np.cumsum(np.append(False, np.diff(column[order]) > 0)) if len(order) else column
    common = np.zeros((n, n), np.float32)
    width = 2048
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [start, start + width])
        slab = np.zeros((n, width), np.float32)
        slab[row[a:b], column[a:b] - start] = 1
        common += slab @ slab.T
    apart = counts[:, None] + counts[None, :] - 2 * common
    both = (sizes[:, None] + sizes[None, :] - apart) / 2
    links = (both > 0) & (both >= threshold * (both + apart) - 1e-9)
    np.fill_diagonal(links, False)
    return links


def _linked(columns: dict[str, list], threshold: float) -> np.ndarray:
    return link_matrix(np.array(columns["n"], np.int64), [np.frombuffer(f, _U) for f in columns["features"]], threshold)


def _links_in_classes(members: DataFrame, threshold: float) -> DataFrame:
    """(node, links): the exact number of links of each member (class, node, n, features) of a class."""
    large = members.groupBy("class").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > BLOCK_MEMBERS)
    if large.isEmpty():
        return _links_in_blocks(members, threshold)
    large = materialise(large, "large-classes")
    rest = _links_in_blocks(members.join(large, "class", "left_anti"), threshold)
    return rest.unionByName(_links_in_large_classes(members.join(large, "class"), threshold))


def _links_in_blocks(members: DataFrame, threshold: float) -> DataFrame:
    """By comparing every two members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, here, columns in _meetings(batches):
            yield pa.RecordBatch.from_pydict({"node": pa.array(columns["node"], pa.int64()), "links": (_linked(columns, threshold) & here).sum(1).astype(np.int64)})

    dealt = _in_blocks(members.select("class", "node", "n", "features"), ["class"], F.octet_length("features") / 8)
    return dealt.mapInArrow(run, "node bigint, links bigint").groupBy("node").agg(F.sum("links").alias("links"))


def _excess(apart: np.ndarray, n: np.ndarray, threshold: float) -> np.ndarray:
    """How many differing shingles of a set, in shares of its size, are more than a link to an equal one allows.

    Two sets are linked if their excesses less twice what their differences have
    in common are not above 0; so surely if the sum of the excesses isn't.
    """
    return apart - (1 - threshold) / (1 + threshold) * n


def _links_in_large_classes(members: DataFrame, threshold: float) -> DataFrame:
    """Links of classes (class, m, node, n, features) too large to compare every two members.

    Differences are taken to the set that most members agree on. Two members
    whose excesses add up to 0 or less are linked whatever they have in common:
    these are counted from the excesses alone. What is left are the pairs with a
    member of positive excess, which meet in blocks.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How often each shingle comes in a few members of a class."""
        for batch in slices(batches):
            held: dict[tuple, list[bytes]] = {}
            for own, m, features in zip(*(batch.column(c).to_pylist() for c in ("class", "m", "features")), strict=True):
                held.setdefault((own, m), []).append(features)
            for (own, m), features in held.items():
                values, k = np.unique(np.frombuffer(b"".join(features), np.int64), return_counts=True)
                yield pa.RecordBatch.from_pydict({"class": pa.array([own] * len(values), pa.int64()), "m": pa.array([m] * len(values), pa.int64()), "shingle": values, "k": k.astype(np.int64)})

    counted = members.select("class", "m", "features").mapInArrow(spread, "class bigint, m bigint, shingle bigint, k bigint").groupBy("class", "m", "shingle").agg(F.sum("k").alias("k"))
    agreed = materialise(counted.where(2 * F.col("k") > F.col("m")).groupBy("class").agg(F.collect_list("shingle").alias("agreed")), "agreed")  # at most twice a member's differences

    def turned(batch: pa.RecordBatch) -> dict:
        features, apart = [], []
        for own, most in zip(batch.column("features").to_pylist(), batch.column("agreed").to_pylist(), strict=True):
            only = np.setxor1d(np.frombuffer(own, np.int64), np.array(most or [], np.int64), assume_unique=True)
            features.append(only.tobytes())
            apart.append(len(only))
        excess = _excess(np.array(apart, np.int64), batch.column("n").to_numpy(), threshold)
        return {c: batch.column(c) for c in ("class", "node", "n")} | {"features": pa.array(features, pa.binary()), "excess": pa.array(np.round(excess, 9), pa.float64())}

    near = materialise(map_arrow(members.join(agreed, "class", "left").select("class", "node", "n", "features", "agreed"), turned, "class bigint, node bigint, n int, features binary, excess double"), "near")
    levels = near.groupBy("class", "excess").agg(F.count(F.lit(1)).alias("k"))
    steps = levels.select("class", F.col("excess").alias("at"), F.lit(0).alias("asks"), "k", "excess").unionByName(levels.select("class", (F.lit(0.0) - F.col("excess")).alias("at"), F.lit(1).alias("asks"), F.lit(0).cast("bigint").alias("k"), "excess"))
    below = Window.partitionBy("class").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)
    sure = steps.withColumn("sure", F.sum("k").over(below)).where("asks = 1").select("class", "excess", (F.col("sure") - F.when(F.col("excess") <= 0, 1).otherwise(0)).alias("sure"))  # less itself
    found = near.select("class", "node", "excess").join(materialise(sure, "sure"), ["class", "excess"]).select("node", F.col("sure").alias("links"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, here, columns in _meetings(batches):
            excess = np.array(columns["excess"])
            links = _linked(columns, threshold) & here & (excess[:, None] + excess[None, :] > 0)
            yield pa.RecordBatch.from_pydict({"node": pa.array(columns["node"], pa.int64()), "links": links.sum(1).astype(np.int64)})

    more = _far_in_blocks(near).mapInArrow(run, "node bigint, links bigint")
    return found.unionByName(more).groupBy("node").agg(F.sum("links").alias("links"))


def _far_in_blocks(near: DataFrame) -> DataFrame:
    """Members of positive excess in blocks that meet each other, and that all others meet; (at: class, i, j), own, ..."""
    far = F.col("excess") > 0
    totals = near.groupBy("class").agg(F.count_if(far).alias("far"), F.count_if(~far).alias("rest"), F.sum(F.when(far, F.octet_length("features") / 8)).alias("far_size"), F.sum(F.when(~far, F.octet_length("features") / 8)).alias("size")).where("far > 0")
    blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(F.col(n) / BLOCK_MEMBERS), F.ceil(F.coalesce(size, F.lit(0)) / BLOCK_SHINGLES)).cast("int")
    totals = materialise(totals.select("class", blocks("far", "far_size").alias("blocks"), blocks("rest", "size").alias("others")), "far")
    dealt = near.join(totals, "class")
    own = F.when(far, F.pmod(F.xxhash64("node"), "blocks")).otherwise(F.col("blocks") + F.pmod(F.xxhash64("node"), "others")).cast("int")
    dealt = dealt.withColumn("own", own)
    meets = F.sequence(F.lit(0), F.col("blocks") + F.when(far, F.col("others")).otherwise(0) - 1)  # the others meet the far ones only
    pairs = F.transform(meets, lambda j: F.struct(F.least(j, F.col("own")).alias("i"), F.greatest(j, F.col("own")).alias("j")))
    dealt = dealt.select(F.explode(pairs).alias("p_"), "own", "class", "node", "n", "features", "excess").select(F.struct("class", "p_.i", "p_.j").alias("at"), "own", "node", "n", "features", "excess")
    return dealt.repartition("at").sortWithinPartitions("at")


def _candidates(members: DataFrame, threshold: float) -> DataFrame:
    """The members (t, p, node, class, n, sig) of a bucket that may be linked with one of another class; the same rule as ``_may_link``."""
    low, n_values = _floor(threshold), TREES * DEPTH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for where, here, columns in _meetings(batches):
            classes, sizes = _codes(columns["class"]), np.array(columns["n"])
            sig = np.array(columns["sig"], np.int64).view(_U)
            values = ((sig[:, :, None] >> _NIBBLE) & _U(15)).astype(np.uint8).reshape(len(sig), -1)
            found = np.zeros(len(sig), bool)
            for k in range(len(sig)):  # a row at a time, so memory is in proportion to the members
                may = here[k] & (classes != classes[k]) & (np.minimum(sizes, sizes[k]) >= threshold * np.maximum(sizes, sizes[k]) - 1e-9)
                may = np.flatnonzero(may)
                apart = (values[may] != values[k]).sum(1)
                found[k] = (1 - apart / (n_values * 15 / 16) >= low).any()
            keys = [columns["node"][k] for k in np.flatnonzero(found)]
            yield pa.RecordBatch.from_pydict({"t": pa.array([where["t"]] * len(keys), pa.int32()), "p": pa.array([where["p"]] * len(keys), pa.int64()), "node": pa.array(keys, pa.int64())})

    dealt = _in_blocks(members.select("t", "p", "node", "class", "n", "sig"), ["t", "p"], F.lit(1))
    return dealt.mapInArrow(run, "t int, p bigint, node bigint").distinct()


def _links_across(members: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) that join the classes of members (t, p, node, class, n, features) of a bucket, enough to connect all that are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, here, columns in _meetings(batches):
            classes = _codes(columns["class"])
            x, y = np.nonzero(_linked(columns, threshold) & here & (classes[:, None] < classes[None, :]))
            root = list(range(len(classes)))
            kept: list[tuple] = []
            for i, j in zip(x.tolist(), y.tolist(), strict=True):
                ends = []
                for c in (int(classes[i]), int(classes[j])):
                    while root[c] != c:
                        root[c] = c = root[root[c]]
                    ends.append(c)
                if ends[0] != ends[1]:
                    root[max(ends)] = min(ends)
                    kept.append((columns["node"][i], columns["node"][j]))
            yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in kept], pa.int64()), "b": pa.array([b for _, b in kept], pa.int64())})

    dealt = _in_blocks(members.select("t", "p", "node", "class", "n", "features"), ["t", "p"], F.octet_length("features") / 8)
    return dealt.mapInArrow(run, "a bigint, b bigint")


def _signed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, h, text), h a hash of the text, and the stored table (doc_id, h, key, n, labels, sig) of them."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).select("doc_id", F.xxhash64("text").alias("h"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows, materialise(map_arrow(rows, _sign, f"doc_id {kind}, h bigint, key binary, n int, labels binary, sig array<bigint>"), "signed")


def _classes(rows: DataFrame, signed: DataFrame, threshold: float, recall: float, count_links: bool) -> DataFrame:
    """(key, first, class_first, n_links) of each distinct set; ``first`` is the smallest (doc_id, h) of its texts, ``class_first`` of its class's."""
    nodes = signed.where("doc_id IS NOT NULL").groupBy("key").agg(F.min(F.struct("doc_id", "h")).alias("first"), F.any_value("n").alias("n"), F.any_value("labels").alias("labels"), F.any_value("sig").alias("sig"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    least = prefix_length(threshold, recall)
    widest = materialise(_buckets(nodes.where("n > 0"), least), "buckets")  # the buckets of longer prefixes are parts of these
    met = materialise(widest.select("node").distinct().join(nodes, "node").select("node", "first", "n", "labels", "sig"), "met")
    node_texts = materialise(rows.join(met.select("node", "first.*"), ["doc_id", "h"]).select("node", "text").dropDuplicates(["node"]), "node-texts")

    found = materialise(_verified(_stars(_buckets(met, DEPTH), met, None, threshold), node_texts, threshold), "links")
    links, classes = found.select("a", "b"), components(found)
    depth = shortened(found, threshold, recall)
    members = widest if depth == least else materialise(_buckets(met, depth), "buckets")
    links = links.unionByName(materialise(_verified(_stars(members, met, classes, threshold), node_texts, threshold).select("a", "b"), "links"))
    classes = components(links)

    placed = materialise(members.join(classes.withColumnRenamed("id", "node"), "node", "left").select("t", "p", "node", F.coalesce("label", "node").alias("class")), "placed")
    mixed = placed.groupBy("t", "p").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("t", "p")
    across = _candidates(placed.join(mixed, ["t", "p"]).join(met.select("node", "n", "sig"), "node"), threshold)
    across = materialise(across.join(placed, ["t", "p", "node"]), "across")
    leaders = across.groupBy("t", "p").agg(F.min("node").alias("leader"))
    across = materialise(_differences(across.join(leaders, ["t", "p"]), node_texts, features=True), "across")
    links = materialise(links.unionByName(_links_across(across, threshold)), "links")
    classes = components(links).select(F.col("id").alias("node"), F.col("label").alias("class"))

    linked = met.select("node", "first").join(classes, "node")
    firsts = linked.groupBy("class").agg(F.min("first").alias("class_first"))
    out = nodes.select("key", "node", "first").join(linked.join(firsts, "class").select("node", "class_first"), "node", "left")
    if count_links:
        inside = materialise(_differences(classes.withColumn("leader", F.col("class")), node_texts, features=True), "members")
        out = out.join(_links_in_classes(inside, threshold), "node", "left")
    else:
        out = out.withColumn("links", F.lit(None).cast("bigint"))
    return out.select("key", "first", F.coalesce("class_first", "first").alias("class_first"), F.coalesce("links", F.lit(0)).alias("n_links"))


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, count_links: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, n_links, copy_of.

    ``class_id`` is the smallest id of all documents linked with it directly or
    through others; ``copy_of`` the smallest id with the same shingles; links
    count the other distinct shingle sets of at least ``threshold`` similarity.
    Texts without a word (and null ones) are copies of each other. Rows with a
    null id are left out of the join: they have null classes and no links. Each
    text is joined for itself, so rows that repeat an id with another text may
    be of another class; rows that repeat both are alike. Texts may be of any
    length: a task holds the sets of one text and its leader, or differences of
    two blocks. An empty table gives an empty result; other columns are ignored.
    """
    rows, signed = _signed(docs, id_col, text_col)
    out = _classes(rows, signed, threshold, recall, count_links)
    joined = signed.select("doc_id", "key").join(out, "key", "left")
    known = F.col("doc_id").isNotNull()
    return joined.select("doc_id", F.when(known, F.col("class_first.doc_id")).alias("class_id"), F.when(known, F.col("n_links")).otherwise(0).cast("bigint").alias("n_links"), F.when(known, F.col("first.doc_id")).alias("copy_of"))


def one_of_each_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, one of each class: that of the smallest id, of its texts that of the smallest hash. Null ids stay."""
    rows, signed = _signed(docs, id_col, text_col)
    first_id, first_h, own_h = fresh(docs, "first_id", "first_h", "own_h")
    kept = _classes(rows, signed, THRESHOLD, RECALL, False).select(F.col("class_first.doc_id").alias(first_id), F.col("class_first.h").alias(first_h)).distinct()
    named = docs.where(F.col(id_col).isNotNull()).withColumn(own_h, F.xxhash64(F.col(text_col).cast("string")))
    same = (F.col(id_col) == F.col(first_id)) & (F.col(own_h) == F.col(first_h))
    one = named.join(kept, same, "left_semi").dropDuplicates([id_col, own_h]).select(*docs.columns)
    return one.unionByName(docs.where(F.col(id_col).isNull()))
