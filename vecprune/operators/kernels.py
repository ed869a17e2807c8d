"""Small Arrow/NumPy kernels for dense products inside a Spark task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# Rows multiplied at once, so that their products stay in the processor cache.
STRIPE = 256


def to_matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """List column as a float64 matrix.  A missing, odd-sized or not finite vector is an
    error here; ``split_valid`` sets such rows aside beforehand."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):  # too large for one chunk
            column = pa.concat_arrays(column.chunks)
    if len(column) == 0:
        return np.zeros((0, 0))
    widths = np.diff(column.offsets.to_numpy())
    if column.null_count or widths.min() != widths.max():
        raise ValueError("vectors are missing or differ in length: apply split_valid first")
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if not np.isfinite(values).all():
        raise ValueError("vectors hold values that are not finite: apply split_valid first")
    return values.reshape(len(column), -1)


def to_lists(matrix: np.ndarray) -> pa.ListArray:
    """Float64 matrix as a list column."""
    rows, width = matrix.shape
    offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * width)
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix).ravel()))


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; zero rows stay zero."""
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    norms[norms == 0.0] = 1.0
    return matrix / norms[:, None]


def best_earlier(vectors: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Per row, the largest product with a row of lower ``pos``, at least 0."""
    order = np.argsort(pos, kind="stable")
    x = vectors[order]
    best = np.zeros(len(x))
    for lo in range(0, len(x), STRIPE):
        hi = min(lo + STRIPE, len(x))
        sims = x[lo:hi] @ x[:hi].T
        # Row lo+i may look at columns before lo+i only.
        sims[:, lo:hi] = np.tril(sims[:, lo:hi], -1)
        best[lo:hi] = np.maximum(sims.max(axis=1), 0.0)
    out = np.empty(len(x))
    out[order] = best
    return out

