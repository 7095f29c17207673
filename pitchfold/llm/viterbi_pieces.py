"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search keeps, for each position of a window, the piece that the best path
to it ends with. A piece has a bounded length, so only the last positions can
still be grown from; once the backpointer paths of all of these meet in one
boundary, the ids before it are committed and the window moves on.

What makes a path the best depends on how the model was trained:

* *unigram* (``Pieces``): scores are log-probabilities; the largest sum wins.
* *BPE* (``MergePieces``): scores are the order of merges, and sums of them mean
  nothing. The text's encoding is the one path of which no two neighbours would
  be cut otherwise: a step from one piece to the next is open if merging the two
  pieces' characters gives these two pieces again. Each position has exactly one
  open path to it, so the search needs no scores, and its ids are those of the
  merges.

Where no piece of the vocabulary reaches across a boundary, all paths meet.
Texts are cut there. What the search gave for a short unit before is looked up
again, new short units of a BPE model are searched side by side in array steps,
and everything else streams.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .common import fresh, map_arrow, mix64, slices, texts
from .unit_memory import END, KEY, UnitMemory, assembled, steps

MARK = "▁"
UNKNOWN_PENALTY = 10
NOWHERE = float("-inf")
NO_PIECE = -1
#: Characters behind a piece: the merges cut them otherwise; no piece begins so; a character without a piece, with none or some that begin with it.
CLOSED, NOTHING, ALONE, LONE_BEGINNING = -2, -3, -4, -5
#: Classes of bytes for the cuts: ASCII each its own, all others one, and END.
WIDE, OVER = 128, 129


class Pieces:
    """Pieces, scores and byte pieces of a SentencePiece model file; the search of unigram models."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes: list[bytes] = [b""] * n
        self.byte_ids = [0] * 256
        self.fallback = np.zeros(n, bool)
        scores: dict[str, tuple[float, int]] = {}
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value], self.bytes[i], self.fallback[i] = i, bytes([value]), True
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                scores[piece] = (model.get_score(i), i)
                self.bytes[i] = piece.replace(MARK, " ").encode()
        self.longest = max(map(len, scores), default=1)
        self.unknown = min((s for s, _ in scores.values()), default=0.0) - UNKNOWN_PENALTY
        #: Score and id of each piece; a mere beginning of pieces has no chance.
        self.table: dict[str, tuple[float, int]] = {p[:k]: (NOWHERE, 0) for p in scores for k in range(1, len(p))}
        self.table.update(scores)
        self.single = frozenset(p for p in scores if len(p) == 1)
        self.dtype = np.dtype(np.uint16 if n <= 1 << 16 else np.uint32)
        self.cuts = self._cut_table(scores)
        self.memory = UnitMemory(self._learn, self.dtype)

    @staticmethod
    def _cut_table(pieces: Iterable[str]) -> np.ndarray:
        """[class before, class after]: whether no piece reaches across."""
        table = np.ones((OVER + 1, OVER + 1), bool)
        for piece in pieces:
            kinds = [0x20 if c == MARK else min(ord(c), WIDE) for c in piece]
            table[kinds[:-1], kinds[1:]] = False
        table[WIDE, WIDE] = False  # may be inside a character
        table[OVER, :] = table[:, OVER] = True
        return table

    def _grow(self, text: str, start: int, stop: int, best: list, back: list, ids: list) -> None:
        """Extend the best paths to start..stop-1 by each piece of ``text`` that begins there; ties keep the earlier path."""
        get, single, n = self.table.get, self.single, len(text)
        for p in range(start, stop):
            base, end = best[p], p + 1
            while end <= n:
                found = get(text[p:end])
                if found is None:
                    break
                score = base + found[0]
                if score > best[end]:
                    best[end], back[end], ids[end] = score, p, found[1]
                end += 1
            if text[p] not in single and base + self.unknown > best[p + 1]:
                best[p + 1], back[p + 1], ids[p + 1] = base + self.unknown, p, NO_PIECE

    def _path(self, text: str, back: list, ids: list, end: int) -> list[int]:
        """Ids of the path that ends at ``end``; a character without a piece becomes its bytes."""
        out: list[int] = []
        while end > 0:
            start, i = back[end], ids[end]
            if i == NO_PIECE:
                out += [self.byte_ids[b] for b in reversed(text[start:end].encode("utf-8", "replace"))]
            else:
                out.append(i)
            end = start
        out.reverse()
        return out

    def stream(self, characters: Iterable[str]) -> Iterator[list[int]]:
        """Ids in runs, each committed once all surviving paths agree on its end. ``characters`` comes in parts of any length."""
        held, best, back, ids, at = "", [0.0], [0], [NO_PIECE], 0
        for more in characters:
            held += more
            best += [NOWHERE] * len(more)
            back += [0] * len(more)
            ids += [NO_PIECE] * len(more)
            while at + 2 * self.longest <= len(held):
                self._grow(held, at, at + self.longest, best, back, ids)
                at += self.longest
                live = {p for p in range(at, at + self.longest + 1) if best[p] > NOWHERE}
                while len(live) > 1:
                    last = max(live)
                    live.remove(last)
                    live.add(back[last])
                if (meet := live.pop()) > 0:
                    yield self._path(held, back, ids, meet)
                    held, best, ids, at = held[meet:], best[meet:], ids[meet:], at - meet
                    back = [max(0, b - meet) for b in back[meet:]]
        self._grow(held, at, len(held), best, back, ids)
        if held:
            yield self._path(held, back, ids, len(held))

    def search(self, marked: str) -> list[int]:
        """Ids of a text in which marks stand for blanks, streamed a window at a time."""
        width = 2 * self.longest
        return [i for run in self.stream(marked[k : k + width] for k in range(0, len(marked), width)) for i in run]

    def _learn(self, units: list[bytes]) -> list[np.ndarray]:
        return [np.array(self.search(u.decode("utf-8").replace(" ", MARK)), self.dtype) for u in units]

    def encode_column(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For parts of a column: the ids of its texts one after the other, where each text's begin and the last's end, and the texts' bytes.

        A text has a mark before it and one for each blank; the empty and the null text have no ids.
        """
        for part in steps(column):
            data, starts = assembled(pc.replace_substring(part, MARK, " "), b" ")
            kind = np.minimum(data, WIDE).astype(np.int64)
            kind[data == END] = OVER
            units = np.append(0, np.flatnonzero(self.cuts.reshape(-1)[kind[:-1] * (OVER + 1) + kind[1:]]) + 1)
            lengths = np.diff(np.append(units, len(data)))
            keep = data[units] != END
            units, lengths = units[keep], lengths[keep]
            flat, counts = self.memory.lookup(data, units, lengths)
            yield flat, np.append(0, np.cumsum(counts))[np.searchsorted(units, starts)], data

    def encode(self, text: str) -> np.ndarray:
        return np.concatenate([flat for flat, _, _ in self.encode_column(pa.array([text]))])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; control and unknown ids give nothing, and the first blank is the mark before the text."""
        out = b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return out[1:] if out[:1] == " " else out


class MergePieces(Pieces):
    """The search of BPE models; of all adjacent pairs that make a piece, the one with the largest score is merged first, ties from the left."""

    #: Steps from piece to piece that are remembered, of about 100 bytes each.
    STEPS = 1 << 18

    def __init__(self, path: str):
        super().__init__(path)
        #: Score of each piece, negated, as the smallest is merged first.
        self.order = {p: -s for p, (s, _) in self.table.items() if s > NOWHERE}
        #: By the id of the piece before: what characters that follow are, an id or one of the codes below.
        self.after: dict[int, dict[str, int]] = {}
        self.held = 0
        self.steps = ArraySteps(self)

    def merged(self, text: str) -> list[str]:
        """The parts of a short text after all merges."""
        get, never = self.order.get, float("inf")
        parts = list(text)
        cost = [get(a + b, never) for a, b in zip(parts, parts[1:])]
        while cost and (least := min(cost)) < never:
            k = cost.index(least)
            parts[k] += parts.pop(k + 1)
            del cost[k]
            if k < len(cost):
                cost[k] = get(parts[k] + parts[k + 1], never)
            if k:
                cost[k - 1] = get(parts[k - 1] + parts[k], never)
        return parts

    def _step(self, known: dict[str, int], before: str, part: str) -> int:
        """The id of ``part`` if it may follow the piece ``before`` (or none): the merges of both then give both again."""
        found = self.table.get(part)
        if len(part) == 1 and part not in self.single:
            code = ALONE if found is None else LONE_BEGINNING
        elif found is None:
            code = NOTHING
        elif found[0] > NOWHERE and self.merged(before + part) == ([before, part] if before else [part]):
            code = found[1]
        else:
            code = CLOSED
        if self.held >= self.STEPS:  # ``known`` itself stays with the caller
            self.after.clear()
            self.held = 0
        self.held += 1
        known[part] = code
        return code

    def _grow(self, text: str, start: int, stop: int, best: list, back: list, ids: list) -> None:
        """Extend the paths to start..stop-1 by each piece that may follow; no other path leads to its end."""
        after, n = self.after, len(text)
        for p in range(start, stop):
            last = ids[p]
            known = after.get(last)
            if known is None:
                known = after[last] = {}
            for end in range(p + 1, n + 1):
                part = text[p:end]
                code = known.get(part)
                if code is None:
                    code = self._step(known, "" if last == NO_PIECE else text[back[p] : p], part)
                if code >= 0:
                    best[end], back[end], ids[end] = 0.0, p, code
                elif code == NOTHING:
                    break
                elif code != CLOSED:
                    best[end], back[end], ids[end] = 0.0, p, NO_PIECE
                    if code == ALONE:
                        break


    def _learn(self, units: list[bytes]) -> list[np.ndarray]:
        """Short units are searched together, in array steps; the others, and those with a character that is no piece, one by one."""
        found = self.steps.search([u if len(u) <= KEY else b"" for u in units])
        slow = [k for k, (u, own) in enumerate(zip(units, found, strict=True)) if own is None or len(u) > KEY]
        for k, own in zip(slow, super()._learn([units[k] for k in slow]), strict=True):
            found[k] = own
        return found


class ArraySteps:
    """The search of a BPE model for many short units at once: a step in all of them is an array operation.

    At each place of all units at once, pieces that begin there are found by
    their bytes, and those that may follow the piece before are kept, as in
    ``MergePieces._grow``. Whether two pieces may stand side by side is worked
    out once and remembered in a table of fixed size.
    """

    SLOTS, PAIRS = 1 << 20, 1 << 20
    _LOW, _HIGH = (np.array([(1 << 8 * min(max(n - at, 0), 8)) - 1 for n in range(KEY + 1)], np.uint64) for at in (0, 8))

    def __init__(self, model: MergePieces):
        self.model = model
        self.texts = {i: p for p, (s, i) in model.table.items() if s > NOWHERE}
        self.start = len(model.bytes)
        whole = [(i, model.bytes[i]) for i in self.texts if 0 < len(model.bytes[i]) <= KEY]
        ids = np.array([i for i, _ in whole], np.int32)
        low, high = np.frombuffer(b"".join(b.ljust(KEY, b"\0") for _, b in whole), "<u8").reshape(-1, 2).T
        size = np.array([len(b) for _, b in whole], np.int64)
        self.low, self.high = (np.zeros(self.start + 1, np.uint64) for _ in range(2))
        self.size = np.zeros(self.start + 1, np.int64)  # 0 of the last, which stands for no piece
        self.low[ids], self.high[ids], self.size[ids] = low, high, size
        self.single = np.zeros(self.start + 1, bool)
        self.single[[i for i, t in self.texts.items() if len(t) == 1]] = True
        self.longest = int(size.max(initial=1))
        #: Two tables of ids by hash; what meets another piece in the first is in the second.
        self.places = [np.full(self.SLOTS, self.start, np.int32) for _ in range(2)]
        first, second = (self._slot(low, high, size, k) for k in (0, 1))
        _, one = np.unique(first, return_index=True)
        self.places[0][first[one]] = ids[one]
        rest = np.setdiff1d(np.arange(len(ids)), one)
        if len(np.unique(second[rest])) < len(rest):
            raise ValueError("pieces meet in both tables")
        self.places[1][second[rest]] = ids[rest]
        self.pairs, self.open = np.full(self.PAIRS, ~np.uint64(0)), np.zeros(self.PAIRS, bool)

    def _slot(self, low: np.ndarray, high: np.ndarray, size: np.ndarray, which: int) -> np.ndarray:
        mixed = mix64(low ^ mix64(high + size.astype(np.uint64)))
        return ((mixed >> np.uint64(32 * which)) & np.uint64(self.SLOTS - 1)).astype(np.int64)

    def _pieces(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these bytes, ``start`` where there is none."""
        out = np.full(low.shape, self.start, np.int32)
        for k in (0, 1):
            held = self.places[k][self._slot(low, high, size, k)]
            same = (self.low[held] == low) & (self.high[held] == high) & (self.size[held] == size)
            out[same] = held[same]
        return out

    def _may_follow(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        key = before.astype(np.uint64) << np.uint64(32) | piece.astype(np.uint64)
        slot = (mix64(key) & np.uint64(self.PAIRS - 1)).astype(np.int64)
        out = self.open[slot]
        missed = np.flatnonzero(self.pairs[slot] != key)
        if len(missed):
            asked, which = np.unique(key[missed], return_inverse=True)
            told = np.zeros(len(asked), bool)
            for k, (a, b) in enumerate(zip((asked >> np.uint64(32)).tolist(), (asked & np.uint64(0xFFFFFFFF)).tolist(), strict=True)):
                first, second = self.texts.get(a, ""), self.texts[b]
                told[k] = self.model.merged(first + second) == ([first, second] if first else [second])
            out[missed] = told[which]
            self.pairs[slot[missed]] = key[missed]
            self.open[slot[missed]] = out[missed]
        return out

    def search(self, units: list[bytes]) -> list[np.ndarray | None]:
        """Ids of each unit of at most KEY bytes; None where a character is no piece, or there is no unit."""
        n = len(units)
        raw = np.frombuffer(b"".join(u.ljust(KEY, b"\0") for u in units), np.uint8).reshape(n, KEY)
        length = np.array([len(u) for u in units], np.int64)
        ids, back = np.full((n, KEY + 1), -1, np.int32), np.zeros((n, KEY + 1), np.int8)
        ids[:, 0] = self.start
        plain = length > 0
        for p in range(int(length.max(initial=0))):
            rows = np.flatnonzero(plain & (length > p) & (ids[:, p] >= 0))
            rest = np.zeros((len(rows), KEY), np.uint8)
            rest[:, : KEY - p] = raw[rows, p:]
            low, high = rest.view("<u8").T
            sizes = np.arange(1, min(KEY - p, self.longest) + 1)
            fits = sizes <= (length[rows] - p)[:, None]
            at, k = np.nonzero(fits)
            size = sizes[k]
            piece = self._pieces(low[at] & self._LOW[size], high[at] & self._HIGH[size], size)
            known = piece != self.start
            at, size, piece = at[known], size[known], piece[known]
            lone = np.zeros(len(rows), bool)
            lone[at[self.single[piece]]] = True
            plain[rows[~lone]] = False
            follows = self._may_follow(ids[rows[at], p], piece)
            where, end = rows[at[follows]], p + size[follows]
            ids[where, end], back[where, end] = piece[follows], p
        every = np.arange(n)
        plain &= ids[every, length] >= 0
        out, count = np.zeros((n, KEY), self.model.dtype), np.zeros(n, np.int64)
        end = np.where(plain, length, 0)
        while (live := np.flatnonzero(end > 0)).size:
            count[live] += 1
            out[live, KEY - count[live]] = ids[live, end[live]]
            end[live] = back[live, end[live]]
        return [out[k, KEY - c :] if c else None for k, c in enumerate(count.tolist())]


UNIGRAM_MODEL, BPE_MODEL = 1, 2  # TrainerSpec.model_type
_MODELS: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """The model of a file with the method of its type, loaded once a Python worker."""
    if path not in _MODELS:
        _MODELS[path] = {UNIGRAM_MODEL: Pieces, BPE_MODEL: MergePieces}[model_type(path)](path)
    return _MODELS[path]


def model_type(path: str) -> int:
    from sentencepiece import sentencepiece_model_pb2

    with open(path, "rb") as f:
        return sentencepiece_model_pb2.ModelProto.FromString(f.read()).trainer_spec.model_type


def encode_documents(docs: DataFrame, model_path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of ``docs``: the columns of ``keep``, then ids. Null and empty texts have no ids.

    Repeated rows are each encoded; equal texts have equal ids, as no two paths tie:
    a unigram model takes the earlier one, a BPE model has one path only. A text
    of any length is taken in steps, whole. An empty table gives an empty
    result. Columns that are not kept are ignored; a kept one may not be called ids.
    """
    if "ids" in (c.lower() for c in keep):
        raise ValueError("a column that is kept can't be called ids, as the result's is")
    (whole,) = fresh(docs, "whole_text")
    rows = docs.select(*keep, F.col(text_col).cast("string").alias(whole))
    schema = rows.drop(whole).schema.add("ids", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_path)
        for batch in slices(batches):
            at = 0
            for flat, bounds, _ in model.encode_column(batch.column(whole)):
                part = batch.slice(at, len(bounds) - 1)
                at += part.num_rows
                ids = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_pydict({**{c: part.column(c) for c in keep}, "ids": ids})

    return rows.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids decode to the empty text."""

    def run(batch: pa.RecordBatch) -> dict:
        model = pieces(model_path)
        return {"doc_id": batch.column("doc_id"), "text": pa.array([model.decode(np.array(x or [], np.int64)) for x in batch.column("ids").to_pylist()], pa.string())}

    return map_arrow(encoded.select("doc_id", "ids"), run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def digest_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """Encode and decode: doc_id, n_ids, n_bytes (byte pieces), ids_crc32 (little-endian 32-bit ids), round_trip.

    ``round_trip`` tells whether the decoded ids give the text again; a text
    that itself holds the mark comes back with blanks, and is false. Null text
    counts as empty, without ids. Repeated rows are each encoded. A text of any
    length is taken in steps, whole. An empty table gives an empty result; other
    columns are ignored.
    """
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batch: pa.RecordBatch) -> dict:
        model = pieces(model_path)
        n, fallback, crc, same = [], [], [], []
        own, at = texts(batch.column("text")), 0
        for flat, bounds, data in model.encode_column(batch.column("text")):
            n.append(np.diff(bounds))
            fallback.append(np.diff(np.append(0, np.cumsum(model.fallback[flat]))[bounds]))
            wide = flat.astype("<u4")
            spans = list(zip(bounds.tolist(), bounds[1:].tolist()))
            crc += [zlib.crc32(wide[a:b]) for a, b in spans]
            part = own[at : at + len(spans)]
            at += len(spans)
            whole = b"".join(map(model.bytes.__getitem__, flat.tolist())) == data[data != END].tobytes()
            same += [MARK not in t if whole else model.decode(flat[a:b]) == t for t, (a, b) in zip(part, spans, strict=True)]
        flat_of = lambda x: pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int64())
        return {"doc_id": batch.column("doc_id"), "n_ids": flat_of(n), "n_bytes": flat_of(fallback), "ids_crc32": pa.array(crc, pa.int64()), "round_trip": pa.array(same, pa.bool_())}

    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_ids bigint, n_bytes bigint, ids_crc32 bigint, round_trip boolean")
