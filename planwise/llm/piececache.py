"""A bounded hash table from 64-bit piece hashes to integer lists, with lookups on whole arrays."""

from __future__ import annotations

import numpy as np


def spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ..., then start[1], ...: the positions of all spans in a row."""
    full = length > 0
    start, length = start[full], length[full]
    step = np.ones(int(length.sum()), dtype=np.int64)
    if len(step):
        at = np.cumsum(length) - length
        step[at] = start
        step[at[1:]] -= start[:-1] + length[:-1] - 1
    return np.cumsum(step, out=step)


def gather_lists(offsets: np.ndarray, values: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists index[0], index[1], ... of a ragged array in a row, and their lengths."""
    first = offsets[index]
    length = offsets[index + 1] - first
    return values[spans(first, length)], length


class PieceCache:
    """Open addressing with linear probing; at capacity, new pieces are no longer kept."""

    def __init__(self, capacity: int = 1_500_000):
        size = 1 << max(4, int(np.ceil(np.log2(capacity * 2))))
        self.capacity, self.mask = capacity, np.uint64(size - 1)
        self.keys = np.zeros(size, dtype=np.uint64)
        self.slot = np.full(size, -1, dtype=np.int32)
        self.offsets = np.zeros(1 << 12, dtype=np.int64)
        self.values = np.zeros(1 << 14, dtype=np.uint32)
        self.n = 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash, or -1."""
        at = h & self.mask
        out = self.slot[at]
        todo = np.flatnonzero((out >= 0) & (self.keys[at] != h))
        while len(todo):
            at[todo] = (at[todo] + np.uint64(1)) & self.mask
            out[todo] = self.slot[at[todo]]
            todo = todo[(out[todo] >= 0) & (self.keys[at[todo]] != h[todo])]
        return out

    def put(self, offsets: np.ndarray, values: np.ndarray) -> None:
        """Write lists after those that are kept, where lists() finds them at n, n + 1, ... until the next call."""
        used, end = self.offsets[self.n], self.n + len(offsets)
        while end > len(self.offsets):
            self.offsets = np.concatenate([self.offsets, np.zeros_like(self.offsets)])
        while used + len(values) > len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        self.values[used : used + len(values)] = values
        self.offsets[self.n + 1 : end] = used + offsets[1:]

    def add(self, h: np.ndarray, offsets: np.ndarray, values: np.ndarray) -> None:
        """Keep lists of distinct hashes that are not there, as far as there is room."""
        room = min(len(h), self.capacity - self.n)
        if room <= 0:
            return
        h, offsets = h[:room], offsets[: room + 1]
        self.put(offsets, values[: offsets[-1]])
        index = np.arange(self.n, self.n + room, dtype=np.int32)
        self.n += room
        at, todo = h & self.mask, np.arange(room)
        while len(todo):
            free = self.slot[at[todo]] < 0
            mine = todo[free]
            self.slot[at[mine]] = index[mine]
            won = self.slot[at[mine]] == index[mine]
            self.keys[at[mine[won]]] = h[mine[won]]
            done = np.zeros(room, dtype=bool)
            done[mine[won]] = True
            todo = todo[~done[todo]]
            at[todo] = (at[todo] + np.uint64(1)) & self.mask

    def lists(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return gather_lists(self.offsets, self.values, index)


class CachedEncoder:
    """Encodes ragged pieces through a cache; subclasses say how pieces are cut and encoded."""

    def __init__(self, capacity: int = 1_500_000):
        self.cache = PieceCache(capacity)

    def encode_pieces(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, values) of the lists of the pieces data[start:end]."""
        raise NotImplementedError

    def encode(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of all pieces in a row, and the number of each."""
        index = self.cache.find(h).astype(np.int64)
        new = np.flatnonzero(index < 0)
        if not len(new):
            return self.cache.lists(index)
        distinct, first, which = np.unique(h[new], return_index=True, return_inverse=True)
        some = new[first]
        offsets, values = self.encode_pieces(data, start[some], end[some])
        # new lists lie after the known ones, which are not copied
        index[new] = self.cache.n + which
        self.cache.put(offsets, values)
        out = self.cache.lists(index)
        self.cache.add(distinct, offsets, values.astype(np.uint32))
        return out
