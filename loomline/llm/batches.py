"""Cut Arrow batches by bytes of text, so that a task's memory doesn't follow the batch's row count."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def text_bytes(column: pa.Array) -> np.ndarray:
    """Length in bytes of each value of a string or binary column (null: 0)."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def by_bytes(batches: Iterable[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``limit`` bytes of ``column``, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(text_bytes(batch.column(column)))
        at, done = 0, 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(at, to - at)
            at, done = to, int(ends[to - 1])


def values(column: pa.Array) -> list[bytes]:
    """A string column's values as UTF-8 bytes, null as empty."""
    import pyarrow.compute as pc

    return pc.fill_null(column.cast(pa.large_binary()), b"").to_pylist()
