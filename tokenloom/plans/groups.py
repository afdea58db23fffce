"""Streaming over partitions that are clustered and sorted by a key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str], flush_rows: int = 20_000) -> Iterator[pa.Table]:
    """Cut a stream of batches, sorted by keys, into tables of whole groups.

    Every table holds one or more complete key groups and at least flush_rows rows
    (except the last). A group larger than that arrives in one table, so callers must
    bound their groups by the way they choose the key (see plans.blocks)."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < flush_rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        starts = group_starts(table, keys)
        cut = int(starts[-1])
        if cut > 0:
            yield table.slice(0, cut)
            table = table.slice(cut)
        held, rows = table.to_batches(), table.num_rows
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Row numbers at which a new key group starts; the first is 0."""
    n = table.num_rows
    change = np.zeros(n, dtype=bool)
    change[0] = True
    for key in keys:
        col = table.column(key).combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks)
        a, b = col.slice(1), col.slice(0, n - 1)
        differs = pc.fill_null(pc.not_equal(a, b), False)
        null_differs = pc.not_equal(pc.is_null(a), pc.is_null(b))
        change[1:] |= np.asarray(pc.or_(differs, null_differs))
    return np.flatnonzero(change)
