"""Secret scan with corpus-wide ownership frequency.

One Python pass finds candidates in whole texts and keeps only their offsets
and a 128-bit hash of the value. Spark then counts, for each hash, the distinct
owners and repositories that hold it, and classes it as *live* (specific to a
few owners, however many copies there are) or *example* (widely copied). All
spans stay with their class; the ``generic`` kind are long mixed tokens.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialise, texts

KINDS = ("assign", "access", "hex", "generic")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
GENERIC = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}")
WORDS = ("passw", "secret", "token", "apikey", "api_key")
MIN_ASSIGN = 6
MIN_ENTROPY = 3.5
#: Tokens of two character classes need more, and to change between classes once in so many characters.
MIN_ENTROPY_TWO, CHANGE_EVERY = 3.9, 6
_CHANGE = re.compile("(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])")


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def looks_generic(value: str) -> bool:
    kinds = bool(re.search("[a-z]", value)) + bool(re.search("[A-Z]", value)) + bool(re.search("[0-9]", value))
    if kinds == 2:
        return len(_CHANGE.findall(value)) * CHANGE_EVERY >= len(value) and entropy(value) >= MIN_ENTROPY_TWO
    return kinds == 3 and entropy(value) >= MIN_ENTROPY


def candidates(text: str) -> list[dict]:
    """Candidates of one text: kind (index into KINDS), start, end in code points, hash of the value."""
    found = []
    lower = text.lower()
    if any(w in lower for w in WORDS):  # a match needs one of these words
        found += [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    taken = sorted((s, e) for _, s, e, _ in found)
    begins, reach = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
    for m in GENERIC.finditer(text):
        before = bisect_left(begins, m.end())  # spans that begin before the token's end
        if not (before and reach[before - 1] > m.start()) and looks_generic(m[0]):
            found.append((3, m.start(), m.end(), m[0]))
    return [{"kind": k, "start": s, "end": e, "h": hashlib.sha256(v.encode("utf-8", "surrogatepass")).digest()[:16]} for k, s, e, v in found]


_CANDS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("h", pa.binary())]))


def _scan(batch: pa.RecordBatch) -> dict:
    found = pa.array([candidates(t) for t in texts(batch.column("text"))], _CANDS)
    return {"doc_id": batch.column("doc_id"), "owner": batch.column("owner"), "repo": batch.column("repo"), "cands": found}


def ownership(spans: DataFrame, max_owners: int) -> DataFrame:
    """h, n_owners, n_repos, live from rows (h, owner, repo); exact distinct counts, pre-aggregated by owner and by repository."""
    owners = spans.groupBy("h", "owner").agg(F.count(F.lit(1)).alias("n")).groupBy("h").agg(F.count(F.lit(1)).alias("n_owners"))
    repos = spans.groupBy("h", "repo").agg(F.count(F.lit(1)).alias("n")).groupBy("h").agg(F.count(F.lit(1)).alias("n_repos"))
    return owners.join(repos, "h").withColumn("live", F.col("n_owners") <= max_owners)


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None, max_owners: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, found = array of (start, kind, end, n_owners, n_repos, live), sorted.

    Without ``repo_col`` each distinct text counts as a repository, so copies of
    a document are one. ``max_owners`` doesn't scale with the corpus: a live
    credential has the owners that were given it, however many others there are.
    Null text counts as empty; null owners and repositories count as one each.
    Repeated rows are scanned each for itself. Work is in proportion to a text's
    length and spans. Spans of one start are in the order of KINDS. An empty
    table gives an empty result; other columns are ignored.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(owner_col).cast("string").alias("owner"),
        (F.col(repo_col).cast("string") if repo_col else F.md5(F.col(text_col).cast("string").cast("binary"))).alias("repo"),
        F.col(text_col).cast("string").alias("text"),
    )
    id_type = rows.schema["doc_id"].dataType.simpleString()
    found = map_arrow(rows, _scan, f"doc_id {id_type}, owner string, repo string, cands array<struct<kind:int,start:bigint,end:bigint,h:binary>>")
    found = materialise(found.withColumn("uid", F.monotonically_increasing_id()), "secrets")
    spans = found.select("uid", "owner", "repo", F.explode("cands").alias("c")).select("uid", "owner", "repo", "c.*")
    owned = materialise(ownership(spans, max_owners), "ownership")  # written, so that a join with a value of most documents can be split
    classed = (
        spans.join(owned, "h")
        .groupBy("uid")
        .agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "n_owners", "n_repos", "live"))).alias("found"))
    )
    return found.select("uid", "doc_id").join(classed, "uid", "left").select("doc_id", F.coalesce("found", F.array().cast(classed.schema["found"].dataType)).alias("found"))


def _joined(spans):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """The columns of the query from those of ``secret_scan``; generic spans that are examples are also in a column of their own."""
    base = F.filter("found", lambda x: x["kind"] < 3)
    count = lambda test: F.size(F.filter("found", test)).cast("bigint")
    return scanned.select(
        "doc_id",
        count(lambda x: x["kind"] == 0).alias("n_assign"),
        count(lambda x: x["kind"] == 1).alias("n_access"),
        count(lambda x: x["kind"] == 2).alias("n_hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"),
        count(lambda x: x["live"]).alias("n_live"),
        count(lambda x: ~x["live"]).alias("n_example"),
        _joined(F.filter("found", lambda x: (x["kind"] == 3) & ~x["live"])).alias("generic_examples"),
    )
