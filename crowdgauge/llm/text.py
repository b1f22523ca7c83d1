"""Words of whole texts as hashes, computed on Arrow's UTF-8 buffers without Python strings."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Fixed value: the bytes between words, \\x20 and \\x09-\\x0D.
SPACES = (9, 10, 11, 12, 13, 32)
#: Bytes of text handled at a time, so that the arrays stay in the processor's cache.
CHUNK = 1 << 19

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_SOLID = np.ones(256, bool)
_SOLID[list(SPACES)] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTES = mix(np.arange(1, 257, dtype=_U) * _U(_BASE))
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as far as a text has needed."""

    def __init__(self, base: int = _BASE):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)

            def powers(base: int) -> np.ndarray:
                row = np.full(size, base, _U)
                row[0] = 1
                return np.cumprod(row)

            self.up, self.down = powers(self.base), powers(self.inverse)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()
_WORD_POWERS = _Powers(0xD6E8FEB86659FD93)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null has no bytes."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, starts.astype(np.int64)


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, document starts within them) of whole documents."""
    if not len(column):
        return
    raw, starts = buffers(column)
    row, n = 0, len(column)
    while row < n:
        end = int(np.searchsorted(starts, starts[row] + size, side="right")) - 1
        end = min(n, max(end, row + 1))
        low = starts[row]
        yield row, end, raw[low : starts[end]], starts[row : end + 1] - low
        row = end


def small(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``size`` bytes of text each, or one longer text.

    What a task holds beside its input stays small that way. At the end, and now and then, memory that
    is free is given back, because Python workers live on between tasks.
    """
    for turn, batch in enumerate(batches):
        if not batch.num_rows:
            yield batch
            continue
        _, starts = buffers(batch.column(column))
        row = 0
        while row < batch.num_rows:
            end = int(np.searchsorted(starts, starts[row] + size, side="right")) - 1
            end = min(batch.num_rows, max(end, row + 1))
            yield batch.slice(row, end - row)
            row = end
        if turn % 4 == 3:
            give_back()
    give_back()


def give_back() -> None:
    """Return free memory to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def spans(solid: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end) of maximal runs of solid bytes that no document border crosses, and the index of
    every document's first run."""
    if not len(solid):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(starts), np.int64)
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    begins = starts[:-1][starts[:-1] < len(solid)]
    first[begins] = solid[begins]
    ends = starts[1:] - 1
    ends = ends[ends >= 0]
    last[ends] = solid[ends]
    b, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return b, e, np.searchsorted(b, starts)


def span_hashes(raw: np.ndarray, b: np.ndarray, e: np.ndarray, table: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes: a polynomial by prefix sums, then mixed."""
    up, down = _POWERS.get(len(raw) + 1)
    prefix = np.zeros(len(raw) + 1, _U)
    np.cumsum(table[raw] * up[:-1], out=prefix[1:])
    return mix((prefix[e] - prefix[b]) * down[b])


def word_hashes(raw: np.ndarray, starts: np.ndarray, fold: bool = False):
    """(hashes, begins, ends, first word of each document); ``fold`` lower-cases A-Z."""
    b, e, words = spans(_SOLID[raw], starts)
    return span_hashes(raw, b, e, _FOLDED if fold else _BYTES), b, e, words


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k hashes from each place on; the last k - 1 places have none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    if k <= 8:
        up, _ = _WORD_POWERS.get(k)
        total = np.zeros(n, _U)
        for j in range(k):
            total += hashes[j : j + n] * up[j]
        return mix(total)
    up, down = _WORD_POWERS.get(len(hashes) + 1)
    prefix = np.zeros(len(hashes) + 1, _U)
    np.cumsum(hashes * up[:-1], out=prefix[1:])
    return mix((prefix[k:] - prefix[:n]) * down[:n])


def shingle_sets(column: pa.Array, k: int, fold: bool = True) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every document, in order.

    A text of fewer than ``k`` words is one shingle; a text without words has the empty set.
    """
    for _, _, raw, starts in chunks(column):
        hashes, _, _, words = word_hashes(raw, starts, fold)
        grams = window_hashes(hashes, k)
        for i in range(len(words) - 1):
            low, high = words[i], words[i + 1]
            if high - low >= k:
                found = np.sort(grams[low : high - k + 1])
                fresh = np.empty(len(found), bool)
                fresh[0] = True
                np.not_equal(found[1:], found[:-1], out=fresh[1:])
                yield found if fresh.all() else found[fresh]
            elif high > low:
                whole = hashes[low:high] * _WORD_POWERS.get(k)[0][: high - low]
                yield mix(whole.sum(keepdims=True) + _U(high - low))
            else:
                yield hashes[:0]


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """A list column from one array per row."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def signed(hashes: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's signed long."""
    return hashes.view(np.int64)
