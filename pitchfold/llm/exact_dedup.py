"""Exact dedup: group by a 128-bit content hash, compare bytes inside groups.

Native: DataFrame functions only. The first aggregation groups by (MD5,
normalised text), so the hash deals out the work and the text inside the key
compares the bytes. Copies collapse map-side before the shuffle, so a group
that holds a third of all rows costs one row a task. Only 56 bytes a distinct
text come out of it, and the second scan joins those back by (MD5, SHA-256),
a join whose large partitions AQE can split.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty. ``lower`` is the fast way for pure ASCII."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _hashed(docs: DataFrame, id_col: str, text_col: str, content_hash: Callable[[Column], Column]) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    return rows.select("doc_id", "norm", content_hash(F.col("norm")).alias("h"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", content_hash: Callable[[Column], Column] = md5_128) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    The row with the largest id stays. Null text equals the empty text. Rows
    that repeat both id and text are one document listed again: they count in
    ``group_size`` and share ``kept``; ``kept_documents`` leaves one of them.
    A null id never stays unless its group has no other (then keep_id is null).
    Texts may be of any length. An empty table gives an empty result; other
    columns are ignored.
    """
    classes = (
        _hashed(docs, id_col, text_col, content_hash)
        .groupBy("h", "norm")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("h", F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size")
    )
    rows = _hashed(docs, id_col, text_col, content_hash).select("doc_id", "h", F.unhex(F.sha2("norm", 256)).alias("sha"))
    return rows.join(classes, ["h", "sha"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one for each distinct text, with all their columns.

    Nulls and repeated rows as in ``exact_dedup``: a null text is an empty one, of
    rows that repeat id and text one stays. Texts may be of any length. An empty
    table gives an empty result; names of other columns don't matter.
    """
    keep_id, keep_sha, sha = fresh(docs, "keep_id", "keep_sha", "sha")
    keys = exact_dedup(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias(keep_id), F.unhex("text_sha256").alias(keep_sha))
    named = docs.withColumn(sha, F.unhex(F.sha2(normalised(F.col(text_col)), 256)))
    same = F.col(id_col).eqNullSafe(F.col(keep_id)) & (F.col(sha) == F.col(keep_sha))
    return named.join(keys, same, "left_semi").dropDuplicates([id_col, sha]).select(*docs.columns)


ORACLE = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
