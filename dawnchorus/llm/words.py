"""Words and shingles of Arrow text batches as 64-bit hashes, for use inside tasks.

A word is a run of bytes other than space and 0x09-0x0D; UTF-8 continues no
character with those bytes, so byte runs and code point runs are the same.
Texts are handled whole, in groups of about ``SLICE_BYTES``, which bounds the
memory of a task whatever the size of an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x + np.uint64((seed * int(_STEP)) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _odd(n: int, seed: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64), seed) | np.uint64(1)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE = _odd(256, 7)
_FOLDED = _BYTE.copy()
_FOLDED[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up = self._table(_BASE, n)
            self.down = self._table(pow(_BASE, -1, 1 << 64), n)
        return self.up, self.down

    @staticmethod
    def _table(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)


_POWERS = _Powers()


@dataclass
class Words:
    """Words of several texts: hashes, byte places, and the first word of each text."""

    hashes: np.ndarray  # uint64 per word
    starts: np.ndarray  # byte offset in the slice
    ends: np.ndarray
    first: np.ndarray  # len(texts) + 1 word positions
    data: np.ndarray  # uint8, the slice
    offsets: np.ndarray  # len(texts) + 1 byte offsets into data

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of whole texts: (row, end row, bytes, offsets). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return
    wide = pa.types.is_large_string(column.type)
    _, at, body = column.buffers()
    places = np.frombuffer(at, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    places = places.astype(np.int64)
    raw = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(places, places[row] + most, side="right")) - 1)
        yield row, end, raw[places[row] : places[end]], places[row : end + 1] - places[row]
        row = end


def words_of(data: np.ndarray, offsets: np.ndarray, fold: bool = False) -> Words:
    """All words of the texts in ``data``; ``fold`` lower-cases A-Z."""
    n = len(data)
    blank = _SPACE[data]
    edge = np.ones(n + 1, dtype=bool)  # a word can't go on over the start of a text
    edge[1:n] = False
    edge[offsets] = True
    opens = ~blank
    opens[1:] &= blank[:-1] | edge[1:n]
    closes = ~blank
    closes[:-1] &= blank[1:] | edge[1:n]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    hashes = np.empty(len(starts), dtype=np.uint64)
    table = _FOLDED if fold else _BYTE
    i = 0
    while i < len(starts):  # runs of words of about a slice, so that the power tables stay short
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE_BYTES, side="right")))
        low, high = starts[i], ends[j - 1]
        up, down = _POWERS.upto(int(high - low) + 1)
        total = np.zeros(high - low + 1, dtype=np.uint64)
        np.cumsum(table[data[low:high]] * up[: high - low], out=total[1:])
        hashes[i:j] = (total[ends[i:j] - low] - total[starts[i:j] - low]) * down[starts[i:j] - low]
        i = j
    hashes = mixed(hashes + (ends - starts).astype(np.uint64) * _STEP)
    return Words(hashes, starts, ends, np.searchsorted(starts, offsets), data, offsets)


def shingles_of(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``size`` words, over text borders too: the caller drops those."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    factors = _odd(size, 1000 + 64 * size + seed)
    total = hashes[:n] * factors[0]
    for k in range(1, size):
        total += hashes[k : k + n] * factors[k]
    return mixed(total, size + seed)


def shingle_runs(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts, one after the other, and the first place of each text.

    A text of fewer words than ``size`` has one shingle, its whole sequence; one without words has none.
    """
    counts = words.counts
    full = shingles_of(words.hashes, size)
    n = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(first[-1], dtype=np.uint64)
    text = np.repeat(np.arange(len(counts)), n)
    place = np.arange(first[-1]) - first[text] + words.first[text]
    whole = counts[text] >= size
    out[whole] = full[place[whole]]
    for t in np.flatnonzero((counts > 0) & (counts < size)):
        out[first[t]] = shingles_of(words.hashes[words.first[t] : words.first[t + 1]], int(counts[t]))[0]
    return out, first


def distinct_runs(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each run, and the new first places."""
    parts, sizes = [], np.zeros(len(first), dtype=np.int64)
    for t in range(len(first) - 1):
        run = np.sort(values[first[t] : first[t + 1]])
        if len(run) > 1:
            run = run[np.concatenate([[True], run[1:] != run[:-1]])]
        parts.append(run)
        sizes[t + 1] = len(run)
    return (np.concatenate(parts) if parts else values[:0]), np.cumsum(sizes)
