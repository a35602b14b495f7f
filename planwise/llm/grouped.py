"""Streams over sorted partitions, group by group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def changes(table: pa.Table | pa.RecordBatch, keys: int) -> np.ndarray:
    """Where a row's first `keys` columns differ from the row before: the starts of runs, with 0."""
    n = table.num_rows
    new = np.zeros(n, dtype=bool)
    if n:
        new[0] = True
        for k in range(keys):
            c = table.column(k)
            x = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c).to_numpy(zero_copy_only=False)
            new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of whole groups, many in each, from batches in which equal keys follow each other."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        starts = changes(b, keys)
        last = int(starts[-1])
        joined = bool(held) and all(held[-1].column(k)[held[-1].num_rows - 1] == b.column(k)[0] for k in range(keys))
        if joined and last == 0:
            held.append(b)
            continue
        if held and not joined:
            yield pa.Table.from_batches(held)
            held = []
        if last:
            held.append(b.slice(0, last))
            yield pa.Table.from_batches(held)
        held = [b.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """One table per group."""
    for t in whole_groups(batches, keys):
        starts = changes(t, keys)
        for s, e in zip(starts, [*starts[1:], t.num_rows], strict=True):
            yield t.slice(int(s), int(e - s))
