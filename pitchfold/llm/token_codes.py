"""Token ids in directly addressable codes.

A segment holds the ids of consecutive documents. Level 0 has the low byte of
every id; a bitmap marks the ids that go on, and level k+1 has the next byte of
those alone. A rank directory counts the bitmap's ones before every 512 bits,
so the byte of id i on the next level is found by one rank, and any id or any
run of ids is read without decoding what lies before it.

Segments are rows of a Parquet table, so Spark's committer takes care of lost
and repeated tasks; the payload of a row is the format described here.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import delete_at_end, shared_dir, slices
from .unit_memory import END, UnitMemory, assembled, steps

SEGMENT_IDS = 1 << 17
#: Units a Python worker remembers: 71 MB with ids of 16 bits.
SLOTS = 1 << 21
RANK_BITS = 512
MAGIC = b"DAC1"
_HEADER = struct.Struct("<4sIQI")  # magic, levels, ids, documents


def _bitmap(more: np.ndarray) -> tuple[bytes, bytes]:
    """Packed bits, and the ones before every RANK_BITS bits."""
    packed = np.packbits(more, bitorder="little")
    packed = np.pad(packed, (0, -len(packed) % (RANK_BITS // 8)))
    ones = np.bitwise_count(packed.reshape(-1, RANK_BITS // 8)).sum(1, dtype=np.uint64)
    return packed.tobytes(), (np.cumsum(ones) - ones).astype("<u4").tobytes()


def pack(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """One segment from the ids of its documents."""
    flat = np.concatenate(ids).astype(np.uint32) if ids else np.empty(0, np.uint32)
    sizes = np.array([len(x) for x in ids], np.int64)
    levels, rest = [], flat
    while True:
        more = rest > 255
        last = not more.any()
        low = (rest & np.uint32(255)).astype(np.uint8).tobytes()
        levels.append((low, b"", b"") if last else (low, *_bitmap(more)))
        if last:
            break
        rest = rest[more] >> np.uint32(8)
    known = np.array([x is not None for x in doc_ids], np.uint8)
    keys = np.array([x or 0 for x in doc_ids], "<i8")
    out = [_HEADER.pack(MAGIC, len(levels), len(flat), len(ids)), known.tobytes(), keys.tobytes(), np.append(0, np.cumsum(sizes)).astype("<u8").tobytes()]
    for level in levels:
        out += [struct.pack("<3Q", *map(len, level)), *level]
    return b"".join(out)


class Segment:
    """Random access to the ids of one packed segment."""

    def __init__(self, payload: bytes):
        magic, levels, self.n, docs = _HEADER.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        at = _HEADER.size
        known = np.frombuffer(payload, np.uint8, docs, at)
        keys = np.frombuffer(payload, "<i8", docs, at + docs)
        at += 9 * docs
        self.doc_ids = [int(k) if ok else None for k, ok in zip(keys, known, strict=True)]
        self.starts = np.frombuffer(payload, "<u8", docs + 1, at).astype(np.int64)
        at += 8 * (docs + 1)
        self.levels = []
        for _ in range(levels):
            sizes = struct.unpack_from("<3Q", payload, at)
            at += 24
            level = []
            for size, kind in zip(sizes, (np.uint8, np.uint8, "<u4"), strict=True):
                level.append(np.frombuffer(payload, kind, size // np.dtype(kind).itemsize, at))
                at += size
            self.levels.append(level)

    def rank(self, level: int, i: int) -> int:
        """Ones before bit i of a level's bitmap."""
        _, bits, ranks = self.levels[level]
        block = i // RANK_BITS
        if block == len(ranks):
            return int(ranks[-1]) + int(np.bitwise_count(bits[(block - 1) * RANK_BITS // 8 :]).sum())
        start = block * RANK_BITS // 8
        whole = int(np.bitwise_count(bits[start : i // 8]).sum())
        part = int(np.bitwise_count(bits[i // 8] & np.uint8((1 << i % 8) - 1))) if i % 8 else 0
        return int(ranks[block]) + whole + part

    def slice(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to stop, reading only their own bytes on each level."""
        out = np.zeros(stop - start, np.uint32)
        where = np.arange(stop - start)
        for level, (low, bits, _) in enumerate(self.levels):
            if start == stop:
                break
            out[where] |= low[start:stop].astype(np.uint32) << np.uint32(8 * level)
            if not len(bits):
                break
            more = np.unpackbits(bits[start // 8 : -(-stop // 8)], bitorder="little")[start % 8 :][: stop - start].astype(bool)
            where, start, stop = where[more], self.rank(level, start), self.rank(level, stop)
        return out

    def __getitem__(self, i: int) -> int:
        """Any one id, by one rank a level."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, (low, bits, _) in enumerate(self.levels):
            value |= int(low[i]) << 8 * level
            if not len(bits) or not bits[i // 8] >> (i % 8) & 1:
                break
            i = self.rank(level, i)
        return value

    def document(self, k: int) -> np.ndarray:
        return self.slice(int(self.starts[k]), int(self.starts[k + 1]))


#: Classes of bytes for the cuts; OTHER is what the pattern's punctuation run takes, UNSURE all that isn't ASCII or is a control character.
LETTER, DIGIT, OTHER, APOSTROPHE, BLANK, WHITE, UNSURE, OVER = range(8)


def _byte_classes() -> np.ndarray:
    out = np.full(256, UNSURE, np.uint8)
    for c in range(0x21, 0x7F):
        out[c] = LETTER if chr(c).isalpha() else DIGIT if chr(c).isdigit() else OTHER
    out[ord("'")], out[ord(" ")], out[END] = APOSTROPHE, BLANK, OVER
    out[9:14] = WHITE
    return out


def _cut_table() -> np.ndarray:
    """[8 * class before + class after]: whether the byte-level pattern always cuts there; runs of white space need more."""
    cuts = np.zeros((8, 8), bool)
    cuts[LETTER, [DIGIT, OTHER, APOSTROPHE]] = cuts[DIGIT, [LETTER, OTHER, APOSTROPHE]] = True
    cuts[OTHER, [LETTER, DIGIT]] = cuts[APOSTROPHE, DIGIT] = True
    cuts[:BLANK, [BLANK, WHITE]] = cuts[UNSURE, [BLANK, WHITE]] = True
    cuts[WHITE, :BLANK] = cuts[WHITE, UNSURE] = True
    cuts[OVER, :] = cuts[:, OVER] = True
    return cuts.reshape(-1)


_CLASS, _CUTS = _byte_classes(), _cut_table()
#: Bytes that may begin or be white space beyond the six ASCII blanks, and the bytes after them that make it so.
_ODD_WHITE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
_LEADS = np.zeros(256, bool)
_LEADS[[*range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True


def _byte_signs() -> list[str]:
    """The character that byte-level BPE writes for each byte: printable Latin-1 as it is, the others in order from U+0100 on."""
    own = [c for c in range(256) if 0x21 <= c <= 0x7E or 0xA1 <= c <= 0xFF and c != 0xAD]
    rest = iter(range(256, 512))
    return [chr(c if c in own else next(rest)) for c in range(256)]


_SIGNS = dict(enumerate(_byte_signs()))
#: Code points below are letters or not in every version of Unicode alike.
SETTLED = "\u0250"


def cuts(data: np.ndarray) -> np.ndarray:
    """Places where the byte-level pattern cuts whatever stands around, in texts that END closes; the last is the end of all.

    A run of white space before another character is cut before its last
    one, which a blank takes along to the word behind it.
    """
    kind = np.append(_CLASS[data], OVER)
    at = np.append(True, _CUTS[kind[:-2] * np.uint8(8) + kind[1:-1]])
    white = (kind == BLANK) | (kind == WHITE)
    at[1:] |= white[:-2] & white[1:-1] & ~white[2:] & (kind[2:] != OVER)
    return np.append(np.flatnonzero(at), len(data))


class Encoder:
    """A tokenizer of the tokenizers library, with a bounded memory of units.

    If the file is a byte-level BPE with the usual pattern, texts are cut where
    that pattern always cuts; units that were met lately are looked up, others
    go to the library. Texts with rare white space or an added token
    go to the library whole, and so does every text if the file is of another kind.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; a pool of threads would only hold memory
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        before, model = config.get("pre_tokenizer") or {}, config["model"]
        self.added = [t["content"].encode() for t in config.get("added_tokens", [])]
        self.usual = (
            (before.get("type"), before.get("add_prefix_space"), before.get("use_regex", True)) == ("ByteLevel", False, True)
            and not config.get("normalizer")
            and (model.get("type"), model.get("dropout"), model.get("ignore_merges", False)) == ("BPE", None, False)
        )
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype(np.uint16 if size <= 1 << 16 else np.uint32)
        self.memory = UnitMemory(self._learn, self.dtype, SLOTS)

    def _whole(self, these: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(these, add_special_tokens=False)]

    def _learn(self, units: list[bytes]) -> list[np.ndarray]:
        """Ids of new units. A run of letters, with or without a blank, is one word of the pattern and goes to the library's model at once."""
        out: list = [None] * len(units)
        tokenize, rest, ids, ends = self.tokenizer.model.tokenize, [], [], []
        latin = b"\xff".join(units).decode("latin-1")  # no unit has this byte
        for k, (plain, signs) in enumerate(zip(latin.split("\xff"), latin.translate(_SIGNS).split(_SIGNS[END]), strict=True)):
            own = plain if plain.isascii() else units[k].decode("utf-8")
            if own.removeprefix(" ").isalpha() and (own is plain or max(own) < SETTLED):
                ids += [t.id for t in tokenize(signs)]
                ends.append((k, len(ids)))
            else:
                rest.append((k, own))
        flat, start = np.array(ids, self.dtype), 0
        for k, end in ends:
            out[k], start = flat[start:end], end
        if rest:
            for (k, _), ids in zip(rest, self._whole([u for _, u in rest]), strict=True):
                out[k] = ids
        return out

    def _odd(self, data: np.ndarray, starts: np.ndarray) -> set[int]:
        """The texts that can't be cut safely."""
        places = np.flatnonzero(_LEADS[data])
        places = [p for p in places.tolist() if _ODD_WHITE.match(data[p : p + 3].tobytes().decode("utf-8", "ignore"))]
        raw = data.tobytes()
        for token in self.added:
            p = raw.find(token)
            while p >= 0:
                places.append(p)
                p = raw.find(token, p + 1)
        return set((np.searchsorted(starts, places, side="right") - 1).tolist())

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a column; null counts as empty."""
        out: list[np.ndarray] = []
        for part in steps(column):
            if not self.usual:
                out += self._whole(part.to_pylist())
                continue
            data, starts = assembled(part)
            places = cuts(data)
            units, lengths = places[:-1], np.diff(places)
            odd = self._odd(data, starts)
            keep = data[units] != END
            for k in odd:
                a, b = np.searchsorted(units, starts[k : k + 2])
                keep[a:b] = False
            units, lengths = units[keep], lengths[keep]
            flat, counts = self.memory.lookup(data, units, lengths)
            bounds = np.append(0, np.cumsum(counts))[np.searchsorted(units, starts)]
            order = sorted(odd)
            whole = dict(zip(order, self._whole([part[k].as_py() for k in order]), strict=True))
            out += [whole[k] if k in whole else flat[a:b] for k, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist()))]
        return out


_ENCODERS: dict[str, Encoder] = {}


def write_codes(docs: DataFrame, tokenizer_path: str, out: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode whole texts in ascending id order and write segments to the table ``out``.

    Null text counts as empty, so it is the end id alone. Ids are whole numbers of
    at most 64 bits; columns of another type are refused. Null ids come first. Rows that repeat an id
    stand next to each other, in order of a hash of their text, so that an id of
    many rows is no single task. A document is never cut, so a segment holds at
    least one and closes once it has ``segment_ids`` ids. An empty table gives
    an empty one; other columns are ignored.
    """
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col}: documents are written in order of a whole number, not of {docs.schema[id_col].dataType.simpleString()}")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    end = np.array([end_id], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(tokenizer_path) or _ENCODERS.setdefault(tokenizer_path, Encoder(tokenizer_path))
        part = TaskContext.get().partitionId()
        keys: list[int | None] = []
        ids: list[np.ndarray] = []
        size = seq = 0

        def segment() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"part": [part], "seq": pa.array([seq], pa.int64()), "n_ids": pa.array([size], pa.int64()), "payload": pa.array([pack(keys, ids)], pa.binary())}, schema=schema)

        schema = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())])
        for batch in slices(batches, 64):
            for key, own in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text")), strict=True):
                keys.append(key)
                ids.append(np.concatenate([own.astype(np.uint32), end]))
                size += len(ids[-1])
                if size >= segment_ids:
                    yield segment()
                    keys, ids, size, seq = [], [], 0, seq + 1
        if keys:
            yield segment()

    ordered.mapInArrow(run, "part int, seq bigint, n_ids bigint, payload binary").write.parquet(out)


def document_index(spark: SparkSession, path: str) -> DataFrame:
    """Read segments back: (doc_id, start, n_tokens, ids_crc32, part, seq, position), one row a document.

    ``start`` counts the ids of all documents before it; part, seq and position
    say where a reader finds it: segment (part, seq), document number position.
    """
    segments = spark.read.parquet(path)
    in_part = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row a written partition
    bases = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    starts = segments.select("part", "seq", F.coalesce(F.sum("n_ids").over(in_part), F.lit(0)).alias("inside")).join(bases, "part").select("part", "seq", (F.col("base") + F.col("inside")).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, payload in zip(batch.column("part").to_pylist(), batch.column("seq").to_pylist(), batch.column("payload"), strict=True):
                segment = Segment(payload.as_buffer().to_pybytes())
                n = len(segment.doc_ids)
                flat = segment.slice(0, segment.n).astype("<u4")
                crcs = [zlib.crc32(flat[a:b]) for a, b in zip(segment.starts, segment.starts[1:], strict=False)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(segment.doc_ids, pa.int64()),
                    "local": segment.starts[:-1],
                    "n_tokens": np.diff(segment.starts),
                    "ids_crc32": pa.array(crcs, pa.int64()),
                    "part": np.full(n, part, np.int32),
                    "seq": np.full(n, seq, np.int64),
                    "position": np.arange(n, dtype=np.int64),
                })

    found = segments.select("part", "seq", "payload").mapInArrow(run, "doc_id bigint, local bigint, n_tokens bigint, ids_crc32 bigint, part int, seq bigint, position bigint")
    return found.join(starts, ["part", "seq"]).select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "part", "seq", "position")


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Write the codes of ``docs`` to a new table in the shared folder and return its document index."""
    path = f"{shared_dir(docs.sparkSession)}/codes-{uuid.uuid4().hex}"
    delete_at_end(docs.sparkSession, path)
    write_codes(docs, tokenizer_path, path, end_id=end_id)
    return document_index(docs.sparkSession, path)
