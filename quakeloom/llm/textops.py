"""Vectorized work on the UTF-8 bytes of Arrow string columns.

Helpers take the bytes of a few hundred documents at a time (``slices``), so that
their arrays stay small whatever the size of an Arrow batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one vectorized step handles (a longer single text is one step).
STEP_BYTES = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_RANDOM = np.random.default_rng(20240229)
BYTE_KEYS = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, over an array."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            _powers[k] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base)]), dtype=np.uint64)
    return _powers


class Spans:
    """Hashes of any spans of one byte array in constant time each (polynomial, modulo 2**64)."""

    def __init__(self, data: np.ndarray):
        powers, self._inverse = _power_tables(len(data) + 1)
        self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_KEYS[data] * powers[: len(data)], dtype=np.uint64)])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        length = (ends - starts).astype(np.uint64)
        return mix64((self._sums[ends] - self._sums[starts]) * self._inverse[starts] + length)


def string_parts(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of len + 1) of a string or binary array; nulls are empty."""
    if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type):
        kind = np.int64
    else:
        kind = np.int32
    if array.null_count:
        array = array.fill_null("" if "string" in str(array.type) else b"")
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    offs = np.frombuffer(offsets, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def release_memory() -> None:
    """Gives the system back what this worker has freed: a worker outlives its tasks, and what its
    allocators keep adds to the next stage's needs. Where the C library can't trim, Arrow's pool is all."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose ``column`` holds about ``limit`` bytes, one row at least; freed
    memory is given back after the last one."""
    _, offs = string_parts(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
    release_memory()


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each document and the total) of the runs of non-space bytes."""
    solid = ~SPACE[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = solid
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = solid
    before[offs] = False
    starts = np.flatnonzero(after[:-1] & ~before[:-1])
    before[1:] = solid
    after[offs] = False
    ends = np.flatnonzero(before[1:] & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offs)
