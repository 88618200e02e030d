"""Arrow batches cut by the bytes of their texts: a task that makes words of a batch holds a bounded amount of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TEXT_BYTES = 1 << 20


def by_bytes(batches: Iterator[pa.RecordBatch], column: int | str, budget: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, in slices of at most ``budget`` bytes of text or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at, done = 0, 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, done + budget, "right")))
            yield batch.slice(at, stop - at)
            at, done = stop, int(ends[stop - 1])
