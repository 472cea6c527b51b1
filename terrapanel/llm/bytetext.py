"""Vectorised UTF-8 helpers shared by the corpus operators.

Arrow string columns arrive in Python workers as one byte buffer plus offsets.  These helpers work on that
buffer directly with NumPy, so a task never makes a Python object per word.  A *slice* is a run of whole
documents of about ``SLICE_BYTES``; a longer document forms a slice of its own (documents are never cut).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

#: A-Z lower-cased; 0 for what is not part of a word: word bytes are 0-9, a-z and all of 0x80-0xFF.
LOWER = np.zeros(256, np.uint8)
for _b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    LOWER[_b] = _b
for _b in range(0x41, 0x5B):
    LOWER[_b] = _b + 32

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
BYTE_KEYS = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _BASE_INV, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


MAX_HELD = 1 << 21
_held: list[tuple[np.ndarray, np.ndarray]] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base and of its inverse; a worker holds one table of at most MAX_HELD."""
    if n > MAX_HELD:
        return _powers(n)
    if not _held or len(_held[0][0]) < n:
        _held[:] = [_powers(min(MAX_HELD, 1 << max(18, int(n).bit_length())))]
    return _held[0]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty.

    Called once a batch: what Arrow still holds of earlier batches is given back first.
    """
    pa.default_memory_pool().release_unused()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    a = column.cast(pa.large_binary())
    if a.null_count:
        a = pc.fill_null(a, b"")
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(a.buffers()[1], np.int64, len(a) + 1, a.offset * 8)
    raw = a.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs (i, j) of whole documents of at most ``limit`` bytes, or of one longer document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def edges(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True that do not cross a document's edge."""
    n = len(is_word)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = is_word.copy(), is_word.copy()
    first[1:] &= ~is_word[:-1]
    last[:-1] &= ~is_word[1:]
    begin = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[begin] = is_word[begin]
    stop = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[stop] = is_word[stop]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


class Words:
    """The words of a slice: 64-bit hash, byte start and end, and the first word of every document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.low = LOWER[data]
        self.start, self.end = edges(self.low != 0, offsets)
        self.doc = np.searchsorted(self.start, offsets)
        up, down = powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_KEYS[self.low] * up[: len(data)], out=total[1:])
        h = (total[self.end] - total[self.start]) * down[self.start]
        self.hash = mix64(h + (self.end - self.start).astype(np.uint64))

    def __len__(self) -> int:
        return len(self.start)

    def windows(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on (only the first len - k + 1 are meaningful)."""
        n = len(self) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        h = np.zeros(n, np.uint64)
        for i in range(k):
            h *= np.uint64(_BASE)
            h += self.hash[i : i + n]
        return mix64(h)

    def whole(self, k: int) -> np.ndarray:
        """True for each word from which k words follow within the document."""
        ok = np.zeros(len(self), bool)
        for a, b in zip(self.doc[:-1], self.doc[1:], strict=True):
            ok[a : max(a, b - k + 1)] = True
        return ok


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenated ranges [start, start + length)."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = lengths > 0
    starts, lengths = np.asarray(starts, np.int64)[keep], lengths[keep]
    steps = np.ones(total, np.int64)
    steps[0] = starts[0]
    at = np.cumsum(lengths)[:-1]
    steps[at] = starts[1:] - (starts[:-1] + lengths[:-1]) + 1
    return np.cumsum(steps)


def slice_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each slice [start, end)."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_KEYS[data] * up[: len(data)], out=total[1:])
    return mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


LANE_BYTES = 256


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes from a and from b on are equal, eight bytes at a time; long slices one by one."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    same = np.ones(len(a), bool)
    live = np.flatnonzero((a != b) & (size <= LANE_BYTES))
    at = 0
    while live.size:
        left = np.minimum(size[live] - at, 8).astype(np.uint64)
        mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left)
        same[live] &= ((lanes[a[live] + at] ^ lanes[b[live] + at]) & mask) == 0
        at += 8
        live = live[same[live] & (size[live] > at)]
    for i in np.flatnonzero((a != b) & (size > LANE_BYTES)):
        same[i] = np.array_equal(data[a[i] : a[i] + size[i]], data[b[i] : b[i] + size[i]])
    return same


def exact_ids(data: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id of each slice, a slice of each id): equal ids exactly for equal bytes.

    ``key`` is a hash of the slices that groups them; every slice is then compared with its group's first by its bytes,
    and the few that differ from it are told apart by their bytes alone.
    """
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, first, ids = np.unique(key, return_index=True, return_inverse=True)
    size, named = end - start, first[ids]
    bad = (size != size[named]) | ~same_bytes(data, start, start[named], np.minimum(size, size[named]))
    if bad.any():
        others: dict[bytes, int] = {}
        extra: list[int] = []
        for i in np.flatnonzero(bad):
            word = data[start[i] : end[i]].tobytes()
            if word not in others:
                others[word] = len(first) + len(extra)
                extra.append(i)
            ids[i] = others[word]
        first = np.concatenate([first, np.array(extra, first.dtype)])
    return ids.astype(np.int64), first.astype(np.int64)
