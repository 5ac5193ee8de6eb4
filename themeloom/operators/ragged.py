"""Arrow list columns as flat numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def ragged(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and the start of each row in them (one more start than rows)."""
    return column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()


def square(column: pa.ListArray) -> np.ndarray:
    """Rows of one length as a matrix."""
    values, starts = ragged(column)
    rows = len(column)
    return values[starts[0] : starts[-1]].reshape(rows, -1)


def list_column(values: np.ndarray) -> pa.ListArray:
    """A matrix as a list column, one row per list."""
    rows, width = values.shape
    starts = np.arange(0, (rows + 1) * width, width, dtype=np.int32) if width else np.zeros(rows + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(starts), pa.array(np.ascontiguousarray(values).ravel(), pa.float64()))
