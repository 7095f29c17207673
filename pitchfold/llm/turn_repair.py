"""Conversation structure repair by a min-plus matrix scan.

The roles of a sound conversation are accepted by a small automaton: nothing,
or a system turn at most and then user and assistant turns in pairs. A turn is a
4x4 matrix over its states: entry (i, j) is the cheapest edit, as (cost, audit),
that takes the turn and leads from i to j, with any insertions before it. The
product of such matrices is associative, so a conversation of any length may be
cut anywhere: Spark deals out turns by ranges, a task multiplies what it holds
of a conversation in a balanced tree, and the products of a conversation that
lies in several tasks are multiplied in a tree of further jobs.

Audits of one entry and cost are never prefixes of each other: letters other
than I stand for turns, so a prefix of the same turns would lack insertions
only, and cost less. Hence the least audit of a product comes of the least
audits of its factors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, slices

#: States: nothing yet, after a system, user or assistant turn.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES, ACCEPTED = range(4), (NOTHING, ASSISTANT)
#: (state, initial of the role): next state.
STEPS = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
LEGAL = ("su", "ua", "au")
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
NAMES = {"u": "user", "a": "assistant"}
#: What a turn is, by its first fault.
SOUND, BLANK, DUPLICATE, CUT = range(4)
FAN = 8
SPACE = " \t\n\x0b\f\r"

Entry = tuple[int, str] | None
Matrix = tuple[Entry, ...]
ONE: Matrix = tuple((0, "") if i == j else None for i in STATES for j in STATES)


def plus(a: Matrix, b: Matrix) -> Matrix:
    return tuple(y if x is None else x if y is None else min(x, y) for x, y in zip(a, b, strict=True))


def times(a: Matrix, b: Matrix) -> Matrix:
    """The product: costs add up, audits are joined, the cheapest and then ASCII-least way counts."""
    out = []
    for i in STATES:
        row = [(k, a[4 * i + k]) for k in STATES if a[4 * i + k] is not None]
        for j in STATES:
            best = None
            for k, (cost, audit) in row:
                y = b[4 * k + j]
                if y is not None and (best is None or cost + y[0] <= best[0]):
                    way = (cost + y[0], audit + y[1])
                    best = way if best is None else min(best, way)
            out.append(best)
    return tuple(out)


def _edge(initial: str, cost: int, letter: str) -> Matrix:
    """Steps by a turn whose role begins so."""
    ways = {4 * i + j: (cost, letter) for (i, own), j in STEPS.items() if own == initial}
    return tuple(ways.get(k) for k in range(16))


@lru_cache(1)
def insertions() -> Matrix:
    """Closure over any number of inserted turns; going round costs more, so three are enough."""
    once = plus(ONE, reduce(plus, [_edge(r, INSERT, "I") for r in NAMES]))
    return times(times(once, once), once)


@lru_cache(64)
def turn_matrix(initial: str, fault: int) -> Matrix:
    """Insertions, then what may be done with the turn."""
    deleted: Matrix = tuple((DELETE, "D") if i == j else None for i in STATES for j in STATES)
    if fault in (BLANK, DUPLICATE):
        return times(insertions(), deleted)
    extra = TRUNCATED if fault == CUT else 0
    ways = [deleted, _edge(initial, extra, "K"), *[_edge(r, REROLE + extra, "R") for r in NAMES]]
    return times(insertions(), reduce(plus, ways))


def power(a: Matrix, n: int) -> Matrix:
    out = ONE
    while n:
        out, a, n = times(out, a) if n & 1 else out, times(a, a) if n > 1 else a, n >> 1
    return out


class Tree:
    """Product of a run of matrices in a balanced tree: equal sizes are multiplied as soon as they meet."""

    def __init__(self) -> None:
        self.held: list[tuple[int, Matrix]] = []

    def add(self, a: Matrix) -> None:
        size = 1
        while self.held and self.held[-1][0] == size:
            size, a = 2 * size, times(self.held.pop()[1], a)
        self.held.append((size, a))

    def product(self) -> Matrix:
        return reduce(lambda b, a: times(a, b), [a for _, a in reversed(self.held)], ONE)


def cheapest(product: Matrix) -> tuple[int, str]:
    """Cost and audit of a whole conversation, from the product of its turns."""
    ends = times(product, insertions())
    return min(e for e in (ends[4 * NOTHING + j] for j in ACCEPTED) if e is not None)


_PART = pa.schema([("conv_id", pa.null()), ("seq", pa.int64()), ("whole", pa.bool_()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("turns", pa.int64()), ("least", pa.int64()), ("most", pa.int64()), ("cost", pa.list_(pa.int64())), ("audit", pa.list_(pa.string()))])
_PART_SQL = "seq bigint, whole boolean, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, turns bigint, least bigint, most bigint, cost array<bigint>, audit array<string>"
_COUNTS = ("blank", "duplicate", "truncated")


class Part:
    """What is known of a stretch of a conversation: its product, counts, and both ends."""

    def __init__(self) -> None:
        self.counts = [0, 0, 0]
        self.illegal = self.turns = 0
        self.first = self.last = self.least = self.most = None
        self.tree = Tree()

    def row(self, turn: int | None, initial: str, faults: Iterable[tuple[int, int]]) -> None:
        """The next turn, with how often each fault comes in a row."""
        for fault, n in faults:
            if n:
                if fault != SOUND:
                    self.counts[fault - 1] += n
                self.illegal += (self.last is not None and self.last + initial not in LEGAL) + (n - 1) * (initial * 2 not in LEGAL)
                self.first, self.last = initial if self.first is None else self.first, initial
                self.tree.add(turn_matrix(initial, fault) if n == 1 else power(turn_matrix(initial, fault), n))
        if turn is not None and turn != self.most:
            self.turns, self.most = self.turns + 1, turn
            self.least = turn if self.least is None else self.least

    def join(self, r: dict) -> None:
        """The next stretch."""
        self.counts = [a + r[c] for a, c in zip(self.counts, _COUNTS, strict=True)]
        self.illegal += r["illegal"] + (self.last is not None and r["first"] is not None and self.last + r["first"] not in LEGAL)
        self.first, self.last = r["first"] if self.first is None else self.first, r["last"] if r["last"] is not None else self.last
        self.turns += r["turns"] - (self.most is not None and self.most == r["least"])
        self.least, self.most = r["least"] if self.least is None else self.least, r["most"] if r["most"] is not None else self.most
        self.tree.add(tuple(None if c is None else (c, a) for c, a in zip(r["cost"], r["audit"], strict=True)))

    def out(self, conv, seq: int, whole: bool) -> dict:
        product = self.tree.product()
        if whole:
            product = (cheapest(product),)
        return {"conv_id": conv, "seq": seq, "whole": whole, **dict(zip(_COUNTS, self.counts, strict=True)), "illegal": self.illegal, "first": self.first, "last": self.last, "turns": self.turns, "least": self.least, "most": self.most, "cost": [e and e[0] for e in product], "audit": [e and e[1] for e in product]}


def _batch(rows: list[dict], id_type: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, _PART.set(0, pa.field("conv_id", id_type)))


def text_key(role: Column, text: Column) -> Column:
    """A 256-bit hash of role and text."""
    return F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without nulls in role and text, and the key that orders turns of one number."""
    rows = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    return rows.withColumn("key", text_key(F.col("role"), F.col("text")))


def faults(turns: DataFrame) -> DataFrame:
    """Turns without their texts: conv_id, turn, initial, key, fault, n, again.

    Equal turns (same number, role and text) are one row with their number ``n``.
    ``again`` says that role and text were seen at an earlier number.
    """
    ended = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(ended == "", BLANK).when(~F.right(ended, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(SOUND)
    rows = turns.select("conv_id", "turn", "role", F.substring("role", 1, 1).alias("initial"), "key", fault.alias("fault"))
    rows = materialise(rows.groupBy("conv_id", "turn", "role", "initial", "key", "fault").agg(F.count(F.lit(1)).alias("n")), "turns")
    first = rows.groupBy(F.col("conv_id").alias("c"), F.col("key").alias("k")).agg(F.min(F.struct("turn")).alias("first"))
    joined = rows.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k")))
    return joined.select("conv_id", "turn", "role", "initial", "key", "fault", "n", (~F.col("turn").eqNullSafe(F.col("first.turn"))).alias("again"))


def _products(rows: DataFrame, id_type: str) -> DataFrame:
    """One row a conversation and task: turns dealt out by ranges, so a long conversation lies in several tasks.

    Only the first and the last conversation of a task may go on in another; the
    others come out ``whole``.
    """
    order = ("conv_id", "turn", "role", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        own, part, first, done = None, None, True, []
        for batch in slices(batches, 4096):
            kind = batch.schema.field("conv_id").type
            names = ("conv_id", "turn", "initial", "fault", "n", "again")
            for conv, turn, initial, fault, n, again in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
                if part is None or conv != own:
                    if part is not None:
                        done.append(part.out(own, task, not first))
                        first = False
                    own, part = conv, Part()
                copies = [(fault, n)] if fault == BLANK else [(DUPLICATE, n)] if again else [(fault, 1), (DUPLICATE, n - 1)]
                part.row(turn, initial, copies)
            if done:
                yield _batch(done, kind)
                done = []
        if part is not None:
            yield _batch([part.out(own, task, False)], kind)

    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("role", "key")
    return dealt.mapInArrow(run, f"conv_id {id_type}, {_PART_SQL}")


def _joined(parts: DataFrame, id_type: str, whole: bool) -> DataFrame:
    """Products of ``FAN`` neighbours of a conversation made one; all of them, and whole, at the end."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["seq"])
        part = Part()
        for r in rows:
            part.join(r)
        return pa.Table.from_batches([_batch([part.out(rows[0]["conv_id"], rows[0]["seq"], whole)], table.schema.field("conv_id").type)])

    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("seq")) - 1
    group = F.floor(nth / FAN).alias("group")
    grouped = parts.select("*", group)
    return grouped.groupBy("conv_id", "group").applyInArrow(lambda t: run(t.drop_columns(["group"])), f"conv_id {id_type}, {_PART_SQL}")


def audits(conversations: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    ``gaps`` counts the turn numbers that lack between the least and the largest
    one; null numbers are left out. Turns are in order of their number, null
    first, then role, then a hash of role and text. Null roles and texts count
    as one space. A null conv_id is a conversation of its own. Equal turns are
    counted before they are dealt out. An empty table gives an empty result;
    other columns are ignored. An audit has a letter a turn, so it must fit into
    one value: conversations may have about a billion turns.
    """
    id_type = conversations.schema["conv_id"].dataType.simpleString()
    parts = materialise(_products(materialise(faults(_turns(conversations)), "faults"), id_type), "products")
    done, open_parts = parts.where("whole"), parts.where("NOT whole")
    most = lambda df: df.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    while most(open_parts) > FAN:
        open_parts = materialise(_joined(open_parts, id_type, False), "products")
    found = done.unionByName(_joined(open_parts, id_type, True))
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("turns"), F.lit(0))
    return found.select("conv_id", gaps.alias("gaps"), *_COUNTS, "illegal", F.get("cost", F.lit(0)).alias("cost"), F.get("audit", F.lit(0)).alias("audit"))


def repaired(conversations: DataFrame, found: DataFrame) -> DataFrame:
    """The turns that the audits leave: conv_id, position, turn, role, text, edit (K, R or I).

    Inserted turns have no number and an empty text. A conversation comes in
    order of position and whole in one partition: an audit travels ahead of its
    turns, which stream past it, so a task holds no conversation in memory.
    """
    turns = _turns(conversations)
    heads = found.select("conv_id", F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(None).cast("binary").alias("key"), F.lit(0).alias("what"))
    ordered = heads.unionByName(turns.withColumn("what", F.lit(1))).repartition("conv_id").sortWithinPartitions("conv_id", "what", "turn", "role", "key").drop("key")
    id_type = conversations.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, audit, at, state, position = None, "", 0, NOTHING, 0
        schema = None
        out: list[tuple] = []

        def put(turn: int | None, role: str, text: str, edit: str, to: int) -> None:
            nonlocal state, position
            out.append((own, position, turn, role, text, edit))
            state, position = to, position + 1

        def fill() -> None:
            """Insertions that stand next in the audit."""
            nonlocal at
            while audit[at : at + 1] == "I":
                r = "a" if state == USER else "u"
                put(None, NAMES[r], "", "I", STEPS[state, r])
                at += 1

        for batch in slices(batches, 1024):
            schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), ("position", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
            for conv, turn, role, text, what in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "what")], strict=True):
                if what == 0:
                    own, audit, at, state, position = conv, text, 0, NOTHING, 0
                    fill()
                    continue
                edit, at = audit[at], at + 1
                if edit == "K":
                    put(turn, role, text, edit, STEPS[state, role[:1]])
                elif edit == "R":
                    r = "a" if state == USER else "u"
                    put(turn, NAMES[r], text, edit, STEPS[state, r])
                fill()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out.clear()

    return ordered.mapInArrow(run, f"conv_id {id_type}, position bigint, turn bigint, role string, text string, edit string")


def text_hashes(ordered: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the turns of ``repaired``, as ``role:text`` joined by newlines; they stream through in order."""
    id_type = ordered.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sha, kind = None, None, None
        for batch in slices(batches, 1024):
            done: list[tuple] = []
            kind = batch.schema.field("conv_id").type
            for conv, position, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "position", "role", "text")], strict=True):
                if position == 0:
                    if sha is not None:
                        done.append((own, sha.hexdigest()))
                    own, sha = conv, hashlib.sha256()
                sha.update(f"{chr(10) * (position > 0)}{role}:{text}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], kind), pa.array([h for _, h in done])], ["conv_id", "repaired_sha256"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([own], kind), pa.array([sha.hexdigest()])], ["conv_id", "repaired_sha256"])

    return ordered.mapInArrow(run, f"conv_id {id_type}, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """The query's damage, by a hash of ``conv_id:turn``: a turn goes, loses its text or its full stops, comes twice, or is the user's."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), plain("role").alias("role"), plain("text").alias("text"), (F.crc32(F.concat_ws(":", plain("conv_id"), plain("turn"))) % 20).alias("h"))
    h = F.col("h")
    rows = rows.where(h != 0).select(
        "conv_id",
        "turn",
        F.when(h == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(h == 1, "").when(h == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(h == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )
    return rows.drop("copy")


def repair_digest(conversations: DataFrame) -> DataFrame:
    """The query's columns: the conversations damaged, audited and repaired; a row for every original conv_id."""
    rows = damaged(conversations)
    found = materialise(audits(rows), "audits")
    hashes = text_hashes(repaired(rows, found))
    ids = conversations.select(F.col("conv_id").alias("id")).distinct()
    all_of = ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    all_of = all_of.join(hashes, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", *_COUNTS, "illegal", "cost")]
    return all_of.select(F.col("id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def _sql() -> str:
    """The query in SQL: the best ways by state, from turn to turn; each way also carries what it leaves."""
    table = "list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(8) AS BIGINT[])), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
    key = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({key}, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INT) + 1])), 4294967295)"
    way = lambda v, cost, letter, line: f"CASE WHEN {v} IS NOT NULL THEN {{'c': {v}.c + {cost}, 'a': {v}.a || '{letter}', 't': {v}.t || {line}}} END"
    deleted = lambda v: way(v, DELETE, "D", "''")
    kept = lambda v, r: f"CASE WHEN may AND initial = '{r}' THEN {way(v, 'cut', 'K', 'chr(10) || role || chr(58) || text')} END"
    rerole = lambda v, r: f"CASE WHEN may THEN {way(v, f'{REROLE} + cut', 'R', f'chr(10) || {chr(39)}{NAMES[r]}:{chr(39)} || text')} END"
    insert = lambda v, r: way(v, INSERT, "I", f"chr(10) || '{NAMES[r]}:'")
    least = lambda *ways: f"list_min(list_filter([{', '.join(ways)}], lambda w: w IS NOT NULL))"
    before = {r: [f"v{i}" for (i, own) in STEPS if own == r] for r in "sua"}
    filled = lambda source: f"SELECT conv_id, n, v0, v1, u AS v2, {least('v3', insert('u', 'a'))} AS v3 FROM (SELECT *, {least('v2', *[insert(v, 'u') for v in before['u']])} AS u FROM ({source}))"
    stepped = f"""SELECT conv_id, n, {deleted('v0')} AS v0, {least(deleted('v1'), *[kept(v, 's') for v in before['s']])} AS v1,
        {least(deleted('v2'), *[f(v, 'u') for v in before['u'] for f in (kept, rerole)])} AS v2, {least(deleted('v3'), *[f(v, 'a') for v in before['a'] for f in (kept, rerole)])} AS v3
        FROM (SELECT f.*, s.v0, s.v1, s.v2, s.v3 FROM s JOIN f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.n = s.n + 1)"""
    nothing = "CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR))"
    begin = f"SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS n, CAST({{'c': 0, 'a': '', 't': ''}} AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR)) AS v0, {nothing} AS v1, {nothing} AS v2, {nothing} AS v3 FROM conversations"
    return f"""
WITH RECURSIVE tab AS (SELECT {table} AS t),
h AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS h FROM conversations, tab),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
      FROM (SELECT *, unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h)),
q AS (SELECT *, substr(role, 1, 1) AS initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ended,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text)) AS n FROM d),
g AS (SELECT *, CASE WHEN ended = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 2 WHEN right(ended, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
        lag(initial) OVER (PARTITION BY conv_id ORDER BY n) || initial AS pair FROM q),
f AS (SELECT conv_id, n, role, text, initial, fault IN (0, 3) AS may, CASE fault WHEN 3 THEN {TRUNCATED} ELSE 0 END AS cut FROM g),
s AS ({filled(begin)} UNION ALL {filled(stepped)}),
best AS (SELECT conv_id, {least('v0', 'v3')} AS w FROM s QUALIFY n = max(n) OVER (PARTITION BY conv_id)),
counts AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
        count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair IS NOT NULL AND pair NOT IN ({', '.join(f"'{p}'" for p in LEGAL)})) AS illegal FROM g GROUP BY conv_id)
SELECT best.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       w.c AS cost, w.a AS audit, sha256(substr(w.t, 2)) AS repaired_sha256
FROM best LEFT JOIN counts ON best.conv_id IS NOT DISTINCT FROM counts.conv_id"""


ORACLE = _sql()
