"""Ids of short pieces of text ("units"), looked up for many texts at once.

Tokenizers cut a text at places that depend on the characters beside them only.
Between two such places the ids don't depend on the rest of the text, so what
was met before can be looked up. Texts are handled as one array of UTF-8 bytes;
cuts, look-ups and the joining of ids are array operations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from .common import mix64

#: Stands after each text; no UTF-8 text has this byte.
END = 0xFF
#: Longest unit that is remembered, in bytes, and most ids of one.
KEY, IDS = 16, 8
STEP_BYTES = 1 << 17
_U = np.uint64
#: By length, which bits of the first and of the second 8 bytes of a unit count.
_MASKS = np.array([[(1 << 8 * max(0, min(8, n - k))) - 1 for n in range(KEY + 1)] for k in (0, 8)], _U)
#: Ids learned in one look-up that need no copy of the table.
SPARE = 1 << 16


def steps(column: pa.Array, most: int = STEP_BYTES) -> Iterator[pa.Array]:
    """The column in slices of about ``most`` bytes, or of one long text; nulls become empty texts."""
    column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.large_string()).fill_null("")
    ends = _offsets(column)[1:]
    start = 0
    while start < len(column):
        base = ends[start - 1] if start else _offsets(column)[0]
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield column.slice(start, stop - start)
        start = stop


def _offsets(column: pa.Array) -> np.ndarray:
    return np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]


def assembled(column: pa.Array, lead: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, END after each and ``lead`` before each that isn't empty; where each text begins, and the end of all."""
    bounds, raw = _offsets(column).tolist(), column.buffers()[2]
    parts = []
    for a, b in zip(bounds, bounds[1:]):
        parts += [lead, raw[a:b], b"\xff"] if a < b else [b"\xff"]
    sizes = np.diff(bounds)
    starts = np.concatenate([[0], np.cumsum(sizes + 1 + len(lead) * (sizes > 0))])
    return np.frombuffer(b"".join(parts), np.uint8), starts


class UnitMemory:
    """A table of ``slots`` units; a unit that was not met lately is learned anew, so memory is bounded whatever the texts hold."""

    def __init__(self, learn: Callable[[list[bytes]], list[np.ndarray]], dtype: np.dtype, slots: int = 1 << 19):
        self.learn, self.slots = learn, slots
        self.keys = np.zeros((2, slots), _U)
        self.length = np.zeros(slots, np.uint8)  # 0: free, as units have a byte at least
        self.count = np.zeros(slots, np.uint8)
        self.pool = np.zeros(slots * IDS + SPARE, dtype)
        self.ids = self.pool[: slots * IDS].reshape(slots, IDS)

    def lookup(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units, one after the other, and the number of each unit's ids."""
        if not len(starts):
            return np.empty(0, self.ids.dtype), np.empty(0, np.int64)
        padded = np.concatenate([data, np.zeros(KEY, np.uint8)])
        eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))  # the 8 bytes from each place on
        known = np.minimum(lengths, KEY)
        key = np.stack([eight[starts] & _MASKS[0][known], eight[starts + 8] & _MASKS[1][known]])
        mixed = mix64(key[0] ^ mix64(key[1] + lengths.astype(_U)))
        slot = (mixed & _U(self.slots - 1)).astype(np.int64)
        hit = (self.length[slot] == lengths) & (self.keys[0][slot] == key[0]) & (self.keys[1][slot] == key[1])
        counts = self.count[slot].astype(np.int64)
        first = slot * IDS
        pool = self.pool
        missed = np.flatnonzero(~hit)
        if len(missed):
            short = missed[lengths[missed] <= KEY]
            _, one, which = np.unique(mixed[short], return_index=True, return_inverse=True)
            one = short[one]
            same = (key[:, one[which]] == key[:, short]).all(0) & (lengths[one[which]] == lengths[short])
            alone = np.concatenate([short[~same], missed[lengths[missed] > KEY]])  # long ones, and different units of one hash
            learned = self.learn([data[a : a + n].tobytes() for a, n in zip(starts[np.concatenate([one, alone])].tolist(), lengths[np.concatenate([one, alone])].tolist())])
            sizes = np.array([len(x) for x in learned], np.int64)
            begin = self.ids.size + np.cumsum(sizes) - sizes
            new = np.concatenate(learned).astype(pool.dtype, copy=False)
            if len(new) <= SPARE:
                pool[self.ids.size : self.ids.size + len(new)] = new
            else:
                pool = np.concatenate([pool[: self.ids.size], new])
            for where, k in ((short[same], which[same]), (alone, len(one) + np.arange(len(alone)))):
                counts[where], first[where] = sizes[k], begin[k]
        total = np.cumsum(counts)
        flat = pool[np.arange(total[-1]) + np.repeat(first - total + counts, counts)]
        if len(missed) and len(fit := np.flatnonzero(sizes[: len(one)] <= IDS)):
            at = slot[one[fit]]
            kept = np.zeros((len(fit), IDS), self.ids.dtype)
            kept[np.arange(IDS) < sizes[fit][:, None]] = new[np.repeat(sizes[: len(one)] <= IDS, sizes[: len(one)]).nonzero()[0]]
            at, last = np.unique(at[::-1], return_index=True)  # one unit a slot
            last = len(fit) - 1 - last
            self.keys[:, at], self.length[at], self.count[at], self.ids[at] = key[:, one[fit]][:, last], lengths[one[fit]][last], sizes[fit][last], kept[last]
        return flat, counts
