"""Mix sources to target weights by blocks of words.

Each source's words are packed into blocks of ``block_words``. The mix is a
sequence of slots, cut into output shards. A source has a quota of slots that
gives its target to the word; of its last slot only so many words count as are
missing. Each shard draws its source counts from a multinomial that is
conditioned on the quotas (a multivariate hypergeometric draw), so totals are
exact and yet every shard is a random mix. A source's slots are numbered; slot
o falls in epoch o // B (B blocks) and takes the block that the epoch's
pseudorandom permutation of 0..B-1 gives for o % B. Slots join blocks by that
index. Everything follows from the seed, so reruns and lost tasks agree.

How many words a document gives depends on quotas and permutations alone; the
draws decide in which shard and slot they stand (``mix_documents`` tells, the
stream is ``mixed_blocks``, and ``mixed_documents`` come in that order).

Only counts by source reach the driver. Word positions inside a source are a
prefix sum in two levels (within hashed buckets, over bucket totals), each as
long as the root of the source's rows, so a source that holds most rows is no
single task.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import fresh, map_arrow, materialise, mix64, slices, texts

BLOCK_WORDS = 64
SHARD_SLOTS = 4096
GROUP_SHARDS = 32
#: Rows of a source's bucket at least; the root of its rows if that is more.
BUCKET_ROWS = 500
MOST_REPEATS = 3
#: A row for each source reaches the driver and every task up to so many; more are planned as a table.
MOST_SOURCES = 100_000
#: Slots of a source that one row deals out, where sources are a table.
CHUNK_SLOTS = 1 << 16
_U = np.uint64
#: Added to the key in the six rounds of the permutation.
_STEPS = np.arange(6, dtype=_U) * _U(0x9E3779B97F4A7C15)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def word_counts(column: pa.Array) -> np.ndarray:
    """Words of each text: runs of bytes other than the six ASCII blanks; null has none.

    The blanks are ASCII, so bytes of UTF-8 give the same words as code points.
    """
    raw = [x.encode("utf-8", "surrogatepass") for x in texts(column)]
    data = np.frombuffer(b" ".join([b"", *raw]), np.uint8)
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    starts = np.flatnonzero(word[1:] & ~word[:-1])
    ends = np.cumsum([len(x) + 1 for x in raw], dtype=np.int64)
    return np.diff(np.searchsorted(starts, ends - 1), prepend=0).astype(np.int64)


def targets(sizes: list[int], weights: list[float], most: float = MOST_REPEATS) -> list[float]:
    """Shares of the total by weight, none above ``most`` times its size; the excess is reshared by weight."""
    total, out = float(sum(sizes)), [0.0] * len(sizes)
    free = set(range(len(sizes)))
    rest = total
    while free:
        weight = sum(weights[i] for i in free)
        over = {i for i in free if rest * weights[i] / weight > most * sizes[i]}
        if not over:
            for i in free:
                out[i] = rest * weights[i] / weight
            break
        for i in over:
            out[i] = float(most * sizes[i])
        free -= over
        rest -= sum(out[i] for i in over)
    return out


def permuted(index: np.ndarray, domain: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Keyed pseudorandom permutation of 0..domain-1, elementwise: a Feistel network, walked until inside."""
    bits = np.ceil(np.log2(np.maximum(domain, 4).astype(np.float64))).astype(np.int64)
    half = ((bits + 1) // 2).astype(_U)
    mask = (_U(1) << half) - _U(1)
    out, todo = index.astype(_U), np.arange(len(index))
    while len(todo):
        x, h, m, k = out[todo], half[todo], mask[todo], key[todo]
        left, right = x >> h, x & m
        for step in _STEPS:
            left, right = right, left ^ (mix64(right + k + step) & m)
        x = left << h | right
        out[todo] = x
        todo = todo[x >= domain[todo].astype(_U)]
    return out.astype(np.int64)


def place_in_permutation(value: int, domain: int, key: int) -> int:
    """The index that ``permuted`` maps to ``value``: the network backwards."""
    bits = math.ceil(math.log2(max(domain, 4)))
    half = _U((bits + 1) // 2)
    mask = (_U(1) << half) - _U(1)
    x = np.array([value], _U)
    while True:
        left, right = x >> half, x & mask
        for step in _STEPS[::-1]:
            left, right = right ^ (mix64(left + _U(key) + step) & mask), left
        x = left << half | right
        if x[0] < domain:
            return int(x[0])


def epoch_key(seed: int, epoch: np.ndarray, sources: int, s: np.ndarray) -> np.ndarray:
    return mix64(mix64(np.full(len(s), seed, _U)) + (epoch * sources + s).astype(_U))


@dataclass(frozen=True)
class Source:
    """``last``: words that count of the last slot."""

    name: str | None
    size: int
    target: float
    blocks: int
    quota: int
    last: int


def _slots_for(words: int, size: int, blocks: int, block_words: int, short_at) -> tuple[int, int]:
    """Slots that give so many words, and the words that count of the last; ``short_at``: where an epoch has the source's last, shorter block."""
    epochs, rest = divmod(words, size)
    if not rest:
        return epochs * blocks, block_words
    lack, at = block_words * blocks - size, short_at(epochs)
    n = -(-rest // block_words)
    if at < n and n * block_words - lack < rest:
        n += 1
    return epochs * blocks + n, rest - ((n - 1) * block_words - (lack if at < n - 1 else 0))


def plan_sources(sizes: dict[str | None, int], weights: dict[str | None, float] | None = None, block_words: int = BLOCK_WORDS, seed: int = 0) -> list[Source]:
    """Sources in code-point order, null last, with targets, block counts and slot quotas.

    Without ``weights`` they weigh 1, 2, 3, repeating. A quota gives the target, rounded to a word.
    """
    names = sorted((n for n in sizes if n is not None)) + [None] * (None in sizes)
    weigh = [weights[n] if weights else 1 + i % 3 for i, n in enumerate(names)]
    out = []
    for i, (name, target) in enumerate(zip(names, targets([sizes[n] for n in names], weigh), strict=True)):
        size = sizes[name]
        blocks = -(-size // block_words)
        short_at = lambda epoch: place_in_permutation(blocks - 1, blocks, int(epoch_key(seed, np.array([epoch]), len(names), np.array([i]))[0]))  # noqa: B023, E731
        out.append(Source(name, size, target, blocks, *(_slots_for(min(round(target), MOST_REPEATS * size), size, blocks, block_words, short_at) if size else (0, block_words))))
    return out


def shard_counts(sources: list[Source], group: int, groups: int, shards: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each shard of a group, its slots by source and each source's first slot number."""
    quota = np.array([s.quota for s in sources], object)
    first = np.array([int(q * group // groups) for q in quota], np.int64)
    rest = np.array([int(q * (group + 1) // groups) for q in quota], np.int64) - first
    rng = np.random.default_rng([seed, group])
    for k in range(shards, 0, -1):
        draw = rng.multivariate_hypergeometric(rest, int(rest.sum()) // k, method="marginals")
        yield draw, first.copy()
        first, rest = first + draw, rest - draw


def slots(spark, sources: list[Source], seed: int = 0, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix: (shard, slot, s, epoch, block, most); s is the source's place in ``sources``, most the words that count of the block."""
    total = sum(s.quota for s in sources)
    groups = max(1, -(-total // (shard_slots * GROUP_SHARDS)))
    shards = max(1, -(-total // (groups * shard_slots)))
    domain = np.array([max(1, s.blocks) for s in sources], np.int64)
    final, last = np.array([s.quota - 1 for s in sources], np.int64), np.array([s.last for s in sources], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in batch.column(0).to_pylist():
                for k, (count, first) in enumerate(shard_counts(sources, group, groups, shards, seed)):
                    shard = group * shards + k
                    s = np.repeat(np.arange(len(sources)), count)
                    ordinal = np.arange(len(s)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
                    epoch = ordinal // domain[s]
                    block = permuted(ordinal % domain[s], domain[s], epoch_key(seed, epoch, len(sources), s))
                    most = np.where(ordinal == final[s], last[s], block_words)
                    order = np.random.default_rng([seed, 1, shard]).permutation(len(s))
                    yield pa.RecordBatch.from_pydict({"shard": np.full(len(s), shard, np.int64), "slot": np.arange(len(s), dtype=np.int64), "s": s[order].astype(np.int32), "epoch": epoch[order].astype(np.int32), "block": block[order], "most": most[order]})

    tasks = max(1, min(groups, 10_000))
    return spark.range(0, groups if total else 0, 1, tasks).mapInArrow(run, "shard bigint, slot bigint, s int, epoch int, block bigint, most bigint")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: str | None = None) -> DataFrame:
    """(doc_id, source, size), one row per row of ``docs``; with ``keep`` also uid, that column."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"), *([F.col(keep).alias("uid")] if keep else []))

    def run(batch: pa.RecordBatch) -> dict:
        own = {"doc_id": batch.column("doc_id"), "source": batch.column("source"), "size": word_counts(batch.column("text"))}
        return {**own, "uid": batch.column("uid")} if keep else own

    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, source string, size bigint{', uid bigint' if keep else ''}")


def segments(rows: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Pack words into blocks: (s, block, at, uid, first, words) from rows (uid, doc_id, s, buckets, size); at is where in the block they stand."""
    rows = rows.where("size > 0").withColumn("bucket", F.pmod(F.xxhash64("doc_id"), "buckets"))
    inside = Window.partitionBy("s", "bucket").orderBy("doc_id", "size", "uid").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("s", "bucket").agg(F.sum("size").alias("n")).select("s", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = rows.withColumn("local", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(bases, ["s", "bucket"]).withColumn("start", F.col("base") + F.col("local"))
    n = F.lit(block_words)
    low = F.floor(F.col("start") / n)
    high = F.floor((F.col("start") + F.col("size") - 1) / n)
    cut = placed.select("s", "uid", "start", "size", F.explode(F.sequence(low, high)).alias("block"))
    begin = F.greatest(F.col("block") * n, F.col("start"))
    end = F.least((F.col("block") + 1) * n, F.col("start") + F.col("size"))
    return cut.select("s", "block", (begin - F.col("block") * n).cast("bigint").alias("at"), "uid", (begin - F.col("start")).cast("bigint").alias("first"), (end - begin).cast("bigint").alias("words"))


@dataclass
class Mix:
    """rows: (uid, doc_id, s, size, source_size, target); segments and slots as above."""

    sources: list[Source]
    rows: DataFrame
    segments: DataFrame
    slots: DataFrame

    def pieces(self) -> DataFrame:
        """(shard, slot, at, uid, epoch, first, words): the mix, word ranges of documents in their places."""
        held = self.segments.join(self.slots.hint("merge"), ["s", "block"])  # Spark can't tell how many slots there are
        words = F.least("words", F.col("most") - F.col("at"))
        return held.select("shard", "slot", "at", "uid", "epoch", "first", words.alias("words")).where("words > 0")

    def taken(self) -> DataFrame:
        """(uid, taken, shard, slot, n_shards): words the mix takes of each row, repeats counted; the first place they stand in, and the shards that have some."""
        by_shard = self.pieces().groupBy("uid", "shard").agg(F.sum("words").alias("words"), F.min("slot").alias("slot"))
        first = F.min(F.struct("shard", "slot"))
        return by_shard.groupBy("uid").agg(F.sum("words").alias("taken"), first.alias("place"), F.count(F.lit(1)).alias("n_shards")).select("uid", "taken", "place.shard", "place.slot", "n_shards")

    def copies(self) -> DataFrame:
        """(uid, copies): for each epoch that takes of a row, a place of it in the mix and its word ranges in order.

        Of its places, a hash takes one: first places would crowd in the first shards.
        """
        place = F.min_by(F.struct("shard", "slot"), F.xxhash64("shard", "slot"))
        ranges = self.pieces().groupBy("uid", "epoch").agg(F.sort_array(F.collect_list(F.struct("first", "words"))).alias("ranges"), place.alias("place"))
        return ranges.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("epoch", "place", "ranges"))).alias("copies"))


def source_table(sizes: DataFrame, weights: dict[str | None, float] | None, seed: int, block_words: int) -> DataFrame:
    """Sources (source, size, n) as ``plan_sources`` plans them: (s, name, source_size, target, blocks, quota, last, before, buckets).

    ``before`` counts the slots of the sources before it. The targets fill up to
    one level of words a weight, the largest at which no source that is not cut
    off by its limit lies above it. Windows run over a row a source.
    """
    spark = sizes.sparkSession
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    rows = sizes.withColumn("s", place.cast("bigint"))
    if weights is None:
        rows = rows.withColumn("w", (1 + F.col("s") % 3).cast("double"))
    else:
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "name string, w double")
        rows = rows.join(given, F.col("source").eqNullSafe(F.col("name")), "left").drop("name")
        rows = rows.withColumn("w", F.coalesce("w", F.raise_error(F.concat(F.lit("no weight for source "), F.coalesce("source", F.lit("null")))).cast("double")))
    rows = materialise(rows.withColumn("limit", F.lit(MOST_REPEATS) * F.col("size")), "sources")
    order = Window.orderBy(F.col("limit") / F.col("w"), "s")
    below, on = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    total = rows.agg(F.sum("size")).first()[0] or 0
    level = (F.lit(total).cast("double") - F.coalesce(F.sum("limit").over(below), F.lit(0))) / F.sum("w").over(on)
    least = rows.select((F.col("limit") / F.col("w")).alias("own"), level.alias("level")).where("own >= level").agg(F.max("level")).first()[0]
    target = F.col("limit").cast("double") if least is None else F.least(F.col("limit").cast("double"), F.col("w") * least)
    count = sizes.count()

    def quotas(batch: pa.RecordBatch) -> dict:
        out: list[tuple[int, int, int]] = []
        for s, size, aim in zip(*(batch.column(c).to_pylist() for c in ("s", "size", "target")), strict=True):
            blocks = -(-size // block_words)
            short_at = lambda epoch: place_in_permutation(blocks - 1, blocks, int(epoch_key(seed, np.array([epoch]), count, np.array([s]))[0]))  # noqa: B023, E731
            out.append((blocks, *(_slots_for(min(round(aim), MOST_REPEATS * size), size, blocks, block_words, short_at) if size else (0, block_words))))
        same = {c: batch.column(c) for c in ("s", "source", "size", "target", "n")}
        return same | {c: pa.array([x[k] for x in out], pa.int64()) for k, c in enumerate(("blocks", "quota", "last"))}

    planned = map_arrow(rows.select("s", "source", "size", target.alias("target"), "n"), quotas, "s bigint, source string, size bigint, target double, n bigint, blocks bigint, quota bigint, last bigint")
    before = F.coalesce(F.sum("quota").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = F.ceil(F.col("n") / F.greatest(F.lit(BUCKET_ROWS), F.floor(F.sqrt(F.col("n").cast("double")))))
    return planned.select("s", F.col("source").alias("name"), F.col("size").alias("source_size"), "target", "blocks", "quota", "last", before.alias("before"), buckets.cast("bigint").alias("buckets"))


def slots_of_table(sources: DataFrame, seed: int = 0, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """``slots`` for sources that are a table.

    All slots stand in one order that a permutation cuts into shards; how many
    each source has in a shard is then the same multinomial draw, conditioned on
    the quotas, as ``shard_counts`` makes. A source's slots are dealt out in chunks.
    """
    sums = sources.agg(F.sum("quota").alias("slots"), F.count(F.lit(1)).alias("n")).first()
    total, count = sums["slots"] or 0, sums["n"]

    def run(batch: pa.RecordBatch) -> dict:
        out: list[list[np.ndarray]] = [[] for _ in range(6)]
        for s, blocks, quota, last, before, chunk in zip(*(batch.column(c).to_pylist() for c in ("s", "blocks", "quota", "last", "before", "chunk")), strict=True):
            ordinal = np.arange(chunk * CHUNK_SLOTS, min(quota, (chunk + 1) * CHUNK_SLOTS), dtype=np.int64)
            own, domain = np.full(len(ordinal), s, np.int64), np.full(len(ordinal), blocks, np.int64)
            epoch = ordinal // blocks
            block = permuted(ordinal % blocks, domain, epoch_key(seed, epoch, count, own))
            place = permuted(before + ordinal, np.full(len(ordinal), total, np.int64), np.full(len(ordinal), mix64(np.array([seed], _U))[0], _U))
            most = np.where(ordinal == quota - 1, last, block_words)
            for column, value in zip(out, (place // shard_slots, place % shard_slots, own, epoch, block, most), strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return {c: pa.array(np.concatenate(v) if v else np.empty(0, np.int64)).cast(k) for c, v, k in zip(("shard", "slot", "s", "epoch", "block", "most"), out, kinds, strict=True)}

    chunks = F.explode(F.sequence(F.lit(0), F.floor((F.col("quota") - 1) / CHUNK_SLOTS))).alias("chunk")
    dealt = sources.where("quota > 0").select("s", "blocks", "quota", "last", "before", chunks)

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 16):
            yield pa.RecordBatch.from_pydict(run(batch))

    return dealt.repartition("s", "chunk").mapInArrow(few, "shard bigint, slot bigint, s bigint, epoch int, block bigint, most bigint")


def plan_mix(rows: DataFrame, weights: dict[str | None, float] | None = None, seed: int = 0, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, most_sources: int = MOST_SOURCES) -> Mix:
    """Plan the mix of rows (uid, doc_id, source, size), a table that is cheap to read again.

    More than ``most_sources`` sources are planned as a table and joined; up to
    that many, their draws are made shard by shard.
    """
    spark = rows.sparkSession
    sizes = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    found = sizes.limit(most_sources + 1).collect()
    if len(found) > most_sources:
        table = materialise(source_table(materialise(sizes, "source-sizes"), weights, seed, block_words), "source-plan")
        named = rows.join(table.select("s", "name", "source_size", "target", "buckets"), F.col("source").eqNullSafe(F.col("name"))).drop("name")
        return Mix([], named, segments(named.select("uid", "doc_id", "s", "buckets", "size"), block_words), slots_of_table(table, seed, block_words, shard_slots))
    sources = plan_sources({r["source"]: r["size"] for r in found}, weights, block_words, seed)
    rows_of = {r["source"]: r["n"] for r in found}
    buckets = [-(-rows_of[s.name] // max(BUCKET_ROWS, math.isqrt(rows_of[s.name]))) for s in sources]
    places = spark.createDataFrame([(i, s.name, s.size, s.target, n) for i, (s, n) in enumerate(zip(sources, buckets, strict=True))], "s int, name string, source_size bigint, target double, buckets bigint")
    named = rows.join(F.broadcast(places), rows["source"].eqNullSafe(places["name"])).drop("name")  # a row for each source, MOST_SOURCES at most
    return Mix(sources, named, segments(named.select("uid", "doc_id", "s", "buckets", "size"), block_words), slots(spark, sources, seed, block_words, shard_slots))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: dict[str | None, float] | None = None, seed: int = 0, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, most_sources: int = MOST_SOURCES) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, source, shard, slot, n_shards.

    Shard and slot are the first place of the document's words in the mix, null
    if none is taken. Null and empty texts have size 0 and are never taken. A
    null source is one source, the last. Repeated rows are each a document. A
    text of any length spreads over as many blocks as it fills. If no text has a
    word, all targets are 0; an empty table gives an empty result; other columns
    are ignored. Sources may be any number.
    """
    rows = materialise(sized(docs, id_col, text_col, source_col).withColumn("uid", F.monotonically_increasing_id()), "mix-sizes")
    mix = plan_mix(rows, weights, seed, block_words, shard_slots, most_sources)
    joined = mix.rows.join(mix.taken().hint("merge"), "uid", "left")
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), "source", "shard", "slot", F.coalesce("n_shards", F.lit(0)).alias("n_shards"))


def mixed_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: dict[str | None, float] | None = None, seed: int = 0, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mixed stream: (shard, slot, source, text), a block of words a slot, in order within each shard's task.

    Words are joined by one blank. A block has ``block_words`` words but for the
    last of a source and the last that it takes. Nulls and ties as in ``mix_documents``.
    """
    rows = materialise(docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text")), "mix-rows")
    sizes = materialise(sized(rows.select("doc_id", "source", "text", "uid"), keep="uid"), "mix-sizes")
    places = plan_mix(sizes, weights, seed, block_words, shard_slots).pieces().groupBy("uid").agg(F.collect_list(F.struct("shard", "slot", "at", "first", "words")).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list] = [[], [], [], [], []]
            for source, text, own in zip(batch.column("source").to_pylist(), texts(batch.column("text")), batch.column("places").to_pylist(), strict=True):
                words = _WORD.findall(text)
                for x in own:
                    for column, value in zip(out, (x["shard"], x["slot"], x["at"], source, " ".join(words[x["first"] : x["first"] + x["words"]])), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_pydict({"shard": pa.array(out[0], pa.int64()), "slot": pa.array(out[1], pa.int64()), "at": pa.array(out[2], pa.int64()), "source": pa.array(out[3], pa.string()), "part": pa.array(out[4], pa.string())})

    cut = rows.join(places.hint("merge"), "uid").select("source", "text", "places").mapInArrow(run, "shard bigint, slot bigint, at bigint, source string, part string")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("at", "part"))), lambda x: x["part"])
    return cut.groupBy("shard", "slot").agg(F.any_value("source").alias("source"), F.array_join(parts, " ").alias("text")).repartition("shard").sortWithinPartitions("shard", "slot")


def cut_copies(text: str, copies: list[list[tuple[int, int]]]) -> list[str]:
    """The text of each copy: the whole text if it takes all words, else its ranges of words, a line feed between parts."""
    spans = [m.span() for m in _WORD.finditer(text)]
    out = []
    for ranges in copies:
        parts: list[list[int]] = []
        for first, words in ranges:
            if parts and parts[-1][1] == first:
                parts[-1][1] = first + words
            else:
                parts.append([first, first + words])
        out.append(text if parts == [[0, len(spans)]] else "\n".join(text[spans[a][0] : spans[b - 1][1]] for a, b in parts))
    return out


def mixed_documents(docs: DataFrame, weights: dict[str | None, float] | None = None, seed: int = 0, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix as documents with the columns of ``docs``: a row for each epoch that takes of a document.

    ``text`` holds the words taken and ``n_chars``, if there is one, their
    length. Rows are dealt out and sorted by a place of their words in the mix,
    so each written file is a random mix of the sources. Nulls, ties
    and repeated rows as in ``mix_documents``. A text of any length is cut in one
    pass. An empty table gives an empty result.
    """
    columns, fields = docs.columns, StructType(docs.schema.fields[:])
    row_id, wanted_copies, shard, slot = fresh(docs, "row_id", "wanted_copies", "shard", "slot")
    rows = materialise(docs.withColumn(row_id, F.monotonically_increasing_id()), "mix-rows")
    sizes = materialise(sized(rows.select(F.col("doc_id"), F.col("text"), F.col("source"), F.col(row_id)), keep=row_id), "mix-sizes")
    copies = plan_mix(sizes, weights, seed, block_words, shard_slots).copies().withColumnsRenamed({"uid": row_id, "copies": wanted_copies})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            asked = batch.column(wanted_copies).to_pylist()
            wanted = [[[(r["first"], r["words"]) for r in c["ranges"]] for c in x] for x in asked]
            made = [cut_copies(t, c) for t, c in zip(texts(batch.column("text")), wanted, strict=True)]
            out = batch.select(columns).take(pa.array(np.repeat(np.arange(batch.num_rows), [len(x) for x in made])))
            flat = [x for y in made for x in y]
            out = out.set_column(columns.index("text"), "text", pa.array(flat, pa.string()))
            if "n_chars" in columns:
                k = columns.index("n_chars")
                out = out.set_column(k, "n_chars", pa.array([len(x) for x in flat]).cast(out.schema.field(k).type))
            for name, part in ((shard, "shard"), (slot, "slot")):
                out = out.append_column(name, pa.array([c["place"][part] for x in asked for c in x], pa.int64()))
            yield out

    for name in (shard, slot):
        fields = fields.add(name, "long")
    mixed = rows.join(copies.hint("merge"), row_id).mapInArrow(cut, fields)
    return mixed.repartition(shard).sortWithinPartitions(shard, slot).select(*columns)
