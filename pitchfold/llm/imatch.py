"""I-Match fingerprints with randomised lexicons.

The lexicon is the terms whose share of documents lies in a band (a band of
inverse document frequency). With shares of at least ``min_share`` it has at
most (distinct terms of an average document) / ``min_share`` terms, whatever
the number of documents, and so may be sent to every task.
Random subsets of the lexicon, some dense and some thin, each hash a document's
sorted distinct terms in the subset. Dense subsets tell apart short texts, thin
ones survive edits of long texts.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .common import mix64, texts

#: Band of document shares; a term of the lexicon is in two documents at least.
MIN_SHARE, MAX_SHARE = 1 / 500, 1 / 5
#: A random subset holds one term in RATE; COPIES subsets of each rate.
RATES = (2, 8, 32, 128, 512, 2048)
COPIES = 10
SUBSETS = len(RATES) * COPIES
HEX = 8
EMPTY = "-" * HEX
_TERM = re.compile(r"\w+")
_U = np.uint64


def terms(text: str) -> set[str]:
    return set(_TERM.findall(text.lower()))


def document_frequencies(docs: DataFrame, text_col: str = "text", flush: int = 300_000) -> DataFrame:
    """(term, df) over all documents; tasks count what they hold and pass on at most ``flush`` terms at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pydict({"term": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})
            counts.clear()
            return batch

        for batch in batches:
            for text in texts(batch.column("text")):
                counts.update(terms(text))
                if len(counts) > flush:
                    yield out()
        if counts:
            yield out()

    rows = docs.select(F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("df"))


def lexicon(docs: DataFrame, text_col: str = "text", min_share: float = MIN_SHARE, max_share: float = MAX_SHARE) -> list[str]:
    """The terms in the band, sorted."""
    n = docs.count()
    band = document_frequencies(docs, text_col).where((F.col("df") >= max(2.0, min_share * n)) & (F.col("df") <= max_share * n))
    return sorted(r["term"] for r in band.select("term").collect())


class Fingerprinter:
    """Fingerprints by the random subsets of one lexicon."""

    def __init__(self, lexicon: list[str], seed: int = 0):
        self.place = {t: i for i, t in enumerate(lexicon)}
        self.codes = np.array([xxhash.xxh64_intdigest(t, seed) for t in lexicon], _U)
        rates = np.repeat(np.array(RATES, _U), COPIES)
        self.member = np.empty((len(lexicon), SUBSETS), bool)
        for j, rate in enumerate(rates):
            self.member[:, j] = mix64(self.codes + np.array([j + 1], _U) * np.array([0x9E3779B97F4A7C15], _U)) % rate == 0

    def fingerprint(self, text: str) -> str:
        """Number of lexicon terms in six hex digits, then a hash for each subset, EMPTY where it has no term of the text."""
        place = self.place
        own = sorted(place[t] for t in terms(text) if t in place)
        if not own:
            return f"{0:06x}" + EMPTY * SUBSETS
        own = np.array(own)
        member, codes = self.member[own], self.codes[own]
        out = [f"{min(len(own), 0xFFFFFF):06x}"]
        for j in range(SUBSETS):
            inside = codes[member[:, j]]
            out.append(xxhash.xxh32_hexdigest(inside.tobytes()) if len(inside) else EMPTY)
        return "".join(out)


#: Text of a range of ids that one task fingerprints, and ranges at most, of 40 bytes each on the driver.
RANGE_BYTES, MOST_RANGES = 1 << 25, 200_000


def likeness(a: str, b: str) -> float:
    """Share of equal hashes among the subsets where either text has a term, 0 to 1.

    Counts the subsets thin enough to hold about two terms of the larger text
    at most; if they are all empty, the next denser rate, and so on. Equal
    fingerprints have likeness 1, also those without any lexicon term.
    """
    if a == b:
        return 1.0
    most = max(int(a[:6], 16), int(b[:6], 16))
    same = either = 0
    for k in range(len(RATES) - 1, -1, -1):
        if RATES[k] * 2 < most and either:
            break
        for j in range(k * COPIES, (k + 1) * COPIES):
            x, y = a[6 + HEX * j : 6 + HEX * (j + 1)], b[6 + HEX * j : 6 + HEX * (j + 1)]
            if x != EMPTY or y != EMPTY:
                either += 1
                same += x == y
    return same / either if either else 0.0


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as many first code points of the following text, or all."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _in_order(docs: DataFrame) -> DataFrame:
    """(bucket, extra, doc_id, text) in descending id order, cut into ranges of ids, one a task.

    Each range also gets, as an extra row, the first document of the next range,
    so every task has the follower of each of its documents; the last range gets
    the first of all. There is a range for each RANGE_BYTES of text, one for a
    shuffle partition at least. Only the ranges' ends and first ids reach the
    driver; a task streams its range, so its memory doesn't depend on their number.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = min(MOST_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES)))
    down = docs.withColumn("x", -F.col("doc_id").cast("double"))
    bounds = sorted(set(down.select("x").where("x IS NOT NULL").approxQuantile("x", [k / n for k in range(1, n)], 1 / (4 * n)))) if n > 1 else []
    ranges = Bucketizer(splits=[-math.inf, *(bounds or [0.0]), math.inf], inputCol="x", outputCol="bucket", handleInvalid="keep")  # null ids come last, as NaN
    dealt = ranges.transform(down.withColumn("x", F.coalesce("x", F.lit(math.nan)))).withColumn("bucket", F.col("bucket").cast("int")).drop("x")

    heads = sorted((r["bucket"], r["head"]) for r in dealt.groupBy("bucket").agg(F.max("doc_id").alias("head")).collect())
    before = [(head, heads[k - 1][0]) for k, (_, head) in enumerate(heads)]  # the first range's head follows the last range
    also = spark.createDataFrame(before, f"head {docs.schema['doc_id'].dataType.simpleString()}, also int")
    rows = dealt.join(F.broadcast(also), F.col("doc_id").eqNullSafe(F.col("head")), "left")  # a row for each range
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("extra"))
    extra = F.struct(F.col("also").alias("bucket"), F.lit(True).alias("extra"))
    places = F.when(F.col("also").isNull(), F.array(own)).otherwise(F.array(own, extra))
    rows = rows.select(F.explode(places).alias("at"), "doc_id", "text").select("at.bucket", "at.extra", "doc_id", "text")
    return rows.repartitionByRange(n + 1, "bucket").sortWithinPartitions("bucket", "extra", F.desc_nulls_last("doc_id"), "text")


#: Of this Python worker, by the name of the lexicon; one at a time.
_FINGERPRINTERS: dict[str, Fingerprinter] = {}


def _fingerprinter(name: str, sent: Broadcast, seed: int) -> Fingerprinter:
    if name not in _FINGERPRINTERS:
        _FINGERPRINTERS.clear()
        _FINGERPRINTERS[name] = Fingerprinter(sent.value, seed)
    return _FINGERPRINTERS[name]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """One row per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null text counts as empty. Ids are numbers, by which documents are ordered;
    others are refused. Rows with one id stand next to each other, by text; null
    ids come last. A single document follows itself. Texts without a lexicon term
    have an empty fingerprint, which is like itself only. Texts may be of any
    length; an empty table gives an empty result and other columns are ignored.
    """
    if not isinstance(docs.schema[id_col].dataType, NumericType):
        raise TypeError(f"{id_col}: documents are ordered by a numeric id, not {docs.schema[id_col].dataType.simpleString()}")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    name = uuid.uuid4().hex
    sent = docs.sparkSession.sparkContext.broadcast(lexicon(rows))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        printer = _fingerprinter(name, sent, seed)
        last: tuple | None = None  # bucket, id, text, fingerprint of the document that waits for its follower
        kind = None
        for batch in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            kind = batch.schema.field("doc_id").type
            for bucket, extra, key, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "extra", "doc_id", "text")), strict=True):
                if last is None and extra:
                    continue  # rows that repeat the id of the first follower
                own = printer.fingerprint(text)
                if last is not None and last[0] == bucket:
                    changed = edited(last[2], text)
                    other = printer.fingerprint(changed)
                    values = (last[1], len(last[2]), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), last[3], other, likeness(last[3], other), likeness(last[3], own))
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
                last = None if extra else (bucket, key, text, own)
            kinds = (kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return _in_order(rows).mapInArrow(run, f"doc_id {id_type}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
