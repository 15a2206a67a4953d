"""Arrow list columns as matrices of whole numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Scaled components up to this size are kept as 64-bit numbers; larger ones as Python's.
LARGE = 1 << 24


def lengths(column: pa.Array) -> np.ndarray:
    """Length of each list whose entries are all finite; -1 for other lists and null."""
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    there = np.maximum(sizes, 0)
    bad = ~np.isfinite(pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64))
    before = np.append(0, np.cumsum(bad))
    ends = np.cumsum(there)
    return np.where(before[ends] > before[ends - there], -1, sizes)


def scaled(column: pa.Array, size: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the lists of ``size`` finite entries, and floor(scale * entry) of each, computed in doubles."""
    at = np.flatnonzero(lengths(column) == size)
    values = pc.cast(column.take(pa.array(at)).flatten(), pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), size)
    values = np.floor(scale * values.astype(np.float64))
    if values.size and np.abs(values).max() > LARGE:
        if not np.isfinite(values).all():
            raise OverflowError(f"a component times {scale} is beyond a double")
        return at, np.array([[int(v) for v in row] for row in values], dtype=object).reshape(len(at), size)
    return at, values.astype(np.int64)
