"""Array kernels over the bytes of Arrow string columns: words, rolling hashes, shingles."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that one step works on; a single longer text is still taken whole.
STEP_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random 64-bit value for each byte.
BYTE_HASH = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))

#: White space: space and the control characters 9 to 13.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes with A-Z lower-cased.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0..n-1 and their inverses modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, STEP_BYTES + 1)
        for i, b in enumerate((_BASE, _BASE_INV)):
            a = np.full(size, b, dtype=np.uint64)
            a[0] = 1
            _powers[i] = np.cumprod(a, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def release() -> None:
    """Give freed memory back to the system: workers live on, and their next task may be another operator's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def as_array(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and its n + 1 offsets, from 0; null counts as empty."""
    a = as_array(column)
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks) if a.num_chunks else pa.array([], pa.string())
    if pa.types.is_string(a.type) or pa.types.is_binary(a.type):
        width = np.int32
    else:
        a, width = a.cast(pa.large_string()), np.int64
    if len(a) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = a.buffers()
    o = np.frombuffer(offsets, dtype=width)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    d = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if a.null_count:  # a null may still cover bytes
        valid = a.is_valid().to_numpy(zero_copy_only=False)
        if (np.diff(o)[~valid] > 0).any():
            return text_bytes(a.fill_null(""))
    return d[o[0] : o[-1]], o - o[0]


def steps(batch: pa.RecordBatch, column: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about `most` bytes of text each."""
    _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield batch.slice(at, min(to, n) - at)
        at = min(to, n)
    release()


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums of hashed bytes times powers; hash_of() takes any substring's hash from it."""
    p, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_HASH[data] * p[: len(data)], out=out[1:])
    return out


def hash_of(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inv = powers(len(prefix))
    return mix64((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(np.uint64))


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of true bytes; runs end with their row."""
    n = len(member)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    first, last = member.copy(), member.copy()
    first[1:] &= ~member[:-1]
    last[:-1] &= ~member[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first[cut] = member[cut]
    last[cut - 1] = member[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word of `[^\\x20\\x09-\\x0D]+`."""
    return runs(~IS_SPACE[data], offsets)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its `width`-word shingles, A-Z lower-cased.

    A row of fewer words has its whole sequence as one shingle; a row without words has none.
    """
    start, end, row = words(data, offsets)
    w = hash_of(prefix_hash(LOWER[data]), start, end)
    n = len(offsets) - 1
    count = np.bincount(row, minlength=n)
    at = np.zeros(n + 1, np.int64)
    np.cumsum(count, out=at[1:])
    multiply = np.uint64(0x9FB21C651E98DF25)
    h = np.full(max(len(w) - width + 1, 0), width, dtype=np.uint64)
    for k in range(width):
        h = mix64(h * multiply + w[k : k + len(h)])
    out = []
    for i in range(n):
        c = count[i]
        if c >= width:
            out.append(np.unique(h[at[i] : at[i + 1] - width + 1]))
        elif c == 0:
            out.append(np.zeros(0, np.uint64))
        else:
            x = np.full(1, c, dtype=np.uint64)
            for k in range(c):
                x = mix64(x * multiply + w[at[i] + k : at[i] + k + 1])
            out.append(x)
    return out
