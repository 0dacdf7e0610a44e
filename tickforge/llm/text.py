"""Words of Arrow string columns as numpy arrays: offsets and 64-bit hashes, without a Python object for each word.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r, which in UTF-8 is `[^\\x20\\x09-\\x0D]+`.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(0x7E47)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = int(_RNG.integers(1, 1 << 62)) * 2 + 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that are hashed at once: some ten arrays of eight bytes for each stand beside them.
_BLOCK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POW = _powers(1 << 12)


def strings(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null("")
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, wide, n + 1, column.offset * np.dtype(wide).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the system: workers are reused, and what they hold counts towards their executor's limit."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


#: What drops the memos that workers keep from one task to the next; modules that keep some add to it.
MEMOS: list[Callable[[], None]] = []


def forget() -> None:
    """Drop the memos of other operators' tasks that this worker served: idle, they would count beside what its executor does now."""
    for drop in MEMOS:
        drop()
    give_back()


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices with about `most` bytes of text at most (a longer text is a slice of its own)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = strings(batch.column(batch.schema.get_field_index(column)))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j
            give_back()


#: White space and ASCII punctuation.
APART = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def words(data: np.ndarray, at: np.ndarray, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte ranges of all runs without bytes of `apart`, and the first run of each text (one entry more than texts)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    space = apart[data]
    edge = np.empty(len(data) + 1, bool)
    edge[1:] = space
    edge[at] = True
    starts = np.flatnonzero(~space & edge[:-1])
    edge[:-1] = space
    edge[at] = True
    ends = np.flatnonzero(~space & edge[1:]) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range; in blocks, so the temporary arrays stay small beside one long text."""
    out = np.empty(len(starts), np.uint64)
    lens = ends - starts
    total = np.cumsum(lens)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + _BLOCK, "right")))
        n = lens[i:j]
        firsts = np.cumsum(n) - n
        pos = np.arange(int(n.sum())) - np.repeat(firsts, n)
        chars = data[pos + np.repeat(starts[i:j], n)]
        pw = _POW if n.max() <= len(_POW) else _powers(int(n.max()))
        out[i:j] = np.add.reduceat(_BYTE[chars] * pw[pos], firsts)
        i = j
    return mix(out + lens.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words that start at each word; the last n-1 places are not valid."""
    out = np.zeros(len(h), np.uint64)
    for j in range(n):
        out[: len(h) - j] = out[: len(h) - j] * np.uint64(0x9E3779B97F4A7C15 | 1) + h[j:]
        if j:
            out[len(h) - j :] = 0
    return mix(out)
