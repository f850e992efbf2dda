"""Vectors in Arrow batches as numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def whole_vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, lengths, values) of the vectors that are not null and hold no
    null and no non-finite entry: their places in the column, their lengths and
    all their entries one behind the other, as doubles."""
    size = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.list_flatten(column).cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls are NaN
    row = np.repeat(np.arange(len(size)), size)
    bad = np.bincount(row[~np.isfinite(values)], minlength=len(size)) > 0
    bad |= column.is_null().to_numpy(zero_copy_only=False)
    return np.flatnonzero(~bad), size[~bad], values[~bad[row]]
