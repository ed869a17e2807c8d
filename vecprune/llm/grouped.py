"""Kernels over groups of sorted rows, without a call per group from Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def group_batches(
    batches: Iterator[pa.RecordBatch], keys: list[str], limit: int = 0
) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of a sorted partition, and where each group starts.

    Rows with the same ``keys`` must be neighbours.  A group that is cut by a batch waits for
    its rest.  With ``limit``, a table ends with the group that brings it to so many rows;
    without, with the batch.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held).combine_chunks()
        starts = _starts(table, keys)
        yield from _bundles(table, starts[:-1], starts[-1], limit)
        rest = table.slice(starts[-1])
        # A long group is put together again only with what comes next.
        held = rest.to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield from _bundles(table, _starts(table, keys), table.num_rows, limit)


def _bundles(
    table: pa.Table, starts: np.ndarray, end: int, limit: int
) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The groups from ``starts`` up to row ``end`` in tables of about ``limit`` rows."""
    a = 0
    while a < len(starts):
        b = len(starts)
        if limit:
            b = min(b, int(np.searchsorted(starts, starts[a] + limit)))
        stop = int(starts[b]) if b < len(starts) else end
        yield table.slice(starts[a], stop - starts[a]).combine_chunks(), starts[a:b] - starts[a]
        a = b


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for key in keys:
        values = table.column(key).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)
