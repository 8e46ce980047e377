"""Arrow <-> numpy conversions for batch functions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def list_matrix(column, dtype=np.float64) -> np.ndarray:
    """A list column whose rows all have the same length, as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column) - column.null_count
    if rows == 0:
        return np.empty((0, 0), dtype=dtype)
    flat = column.flatten()
    if flat.null_count:
        raise ValueError("vectors must not hold null elements")
    values = flat.to_numpy(zero_copy_only=False)
    width, rest = divmod(len(values), rows)
    if rest or np.any(np.diff(column.drop_null().offsets.to_numpy()) != width):
        raise ValueError("all vectors of a table must have the same length")
    return values.reshape(rows, width).astype(dtype, copy=False)


def matrix_list(values: np.ndarray, element_type) -> pa.Array:
    """A matrix as a list column."""
    rows, width = values.shape
    offsets = np.arange(0, (rows + 1) * width, width, dtype=np.int32) if width else np.zeros(rows + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.reshape(-1), type=element_type))
