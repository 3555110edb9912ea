"""Vectorised reading of Arrow text columns: many documents at once as one byte array."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import TypeVar

import numpy as np
import pyarrow as pa

T = TypeVar("T")

CHUNK_BYTES = 2 << 20  # texts worked on at once; a longer text is a chunk of its own
SLICE_ROWS = 1000  # of a batch that are worked on and sent on together

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words of digits, a-z (after lower-casing) and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
_BYTE_VALUE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}
_kept: dict[str, object] = {}  # tables of this worker


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. n - 1 modulo 2 ** 64; grows on demand."""
    if len(_powers.get(name, ())) < n:
        steps = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        steps[0] = 1
        _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers[name][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values, so that any bits of them can be used."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def kept(name: str, make: Callable[[], T]) -> T:
    """What make() gives, kept by a worker from task to task until another operator releases it."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """batches in parts of at most so many rows, so that what is made of a text, and sent on, is never held for a whole batch.

    Tables that another operator keeps in this worker are released.
    """
    _kept.clear()
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


@dataclass
class Chunk:
    """Rows first..last of a batch: their bytes end to end; document i is data[offs[i]:offs[i + 1]]. A null is empty."""

    first: int
    last: int
    data: np.ndarray
    offs: np.ndarray
    null: np.ndarray

    @property
    def n(self) -> int:
        return self.last - self.first

    def text(self, i: int) -> bytes:
        return self.data[self.offs[i] : self.offs[i + 1]].tobytes()

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        """The document of each byte position."""
        return np.searchsorted(self.offs, at, "right") - 1


def chunks(column: pa.Array, most: int = CHUNK_BYTES, rows: int = 1 << 20) -> Iterator[Chunk]:
    """A text column in pieces of about most bytes and at most so many rows, without copying or decoding."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    null = column.is_null().to_numpy(zero_copy_only=False)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        j = min(j, n, i + rows)
        yield Chunk(i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], null[i:j])
        i = j


@dataclass
class Words:
    start: np.ndarray  # byte positions in the chunk
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray  # of the lower-cased word
    prefix: np.ndarray | None = None  # hashes of its beginnings; 0 where the word is shorter


def summed(low: np.ndarray) -> np.ndarray:
    """Sums of byte values, each by its place; differences of them make hashes of stretches."""
    total = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[low] * _power("up", MULTIPLIER, len(low)), out=total[1:])
    return total


def stretch_hashes(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from start to end, wherever they lie."""
    total = summed(low)
    return mix((total[end] - total[start]) * _power("down", _INVERSE, len(low) + 1)[start])


def words(c: Chunk, table: np.ndarray = ALNUM, prefixes: tuple[int, ...] = ()) -> Words:
    """Maximal runs of bytes in table, A-Z lower-cased; no run crosses documents. prefixes: numbers of bytes."""
    low = LOWER[c.data]
    size = len(low)
    inside = np.zeros(size + 2, bool)
    inside[1:-1] = table[low]
    border = np.zeros(size + 1, bool)
    border[c.offs] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | border[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | border[1:])) + 1
    total = summed(low)
    down = _power("down", _INVERSE, size + 1)[start]
    h = mix((total[end] - total[start]) * down)
    if not prefixes:
        return Words(start, end, c.doc_of(start), h)
    begin = np.zeros((len(start), len(prefixes)), np.uint64)
    for k, n in enumerate(prefixes):
        stop = np.minimum(start + n, end)
        begin[:, k] = np.where(end - start >= n, mix((total[stop] - total[start]) * down + np.uint64(n)), 0)
    return Words(start, end, c.doc_of(start), h, begin)


def per_doc(n: int, doc: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(doc, weights, minlength=n)


def ranges(lo: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i its lo[i] .. lo[i] + count[i] - 1, end to end: (i, value)."""
    who = np.repeat(np.arange(len(lo)), count)
    first = np.cumsum(count) - count
    return who, lo[who] + np.arange(len(who)) - first[who]
