"""Arrow batches in parts of bounded text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(batches: Iterable[pa.RecordBatch], text_col: str, most: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Parts of batches that hold one text or up to ``most`` bytes of several, with their texts.

    Only a part's texts become Python strings at a time.
    """
    for batch in batches:
        column = batch.column(text_col)
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, first = np.cumsum(sizes), 0
        while first < len(sizes):
            before = int(ends[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(first, last - first), column.slice(first, last - first).to_pylist()
            first = last
