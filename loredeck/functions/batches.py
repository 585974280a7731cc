"""Arrow columns in parts of bounded text, so that what a task holds in Python doesn't grow with its batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def parts(texts: pa.Array, most: int) -> Iterator[pa.Array]:
    """The column's rows in order, cut so that a part has `most` bytes of text, or is one row."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size, dtype=np.int64)
    start, before = 0, 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield texts.slice(start, stop - start)
        start, before = stop, int(ends[stop - 1])
