"""Columns of vectors as matrices, and back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def matrix(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A list column as doubles (n x width, short rows end in zeros), and which rows are neither null nor hold null or non-finite entries."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), max(int(size.max(initial=0)), width or 0)))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)] = values
    good = pc.is_valid(column).to_numpy(zero_copy_only=False) & np.isfinite(out).all(axis=1)
    return out, good


def widen(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] >= width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def binary_rows(m: np.ndarray) -> pa.Array:
    """One binary value for each row of a matrix."""
    data = np.ascontiguousarray(m)
    per = data.shape[1] * data.itemsize
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer((np.arange(len(data) + 1, dtype=np.int64) * per).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def from_binary_rows(column: pa.Array, dtype) -> np.ndarray:
    """The matrix that ``binary_rows`` packed; all rows have one length."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1) if len(column) else np.zeros((0, 0), dtype)


def whole_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of matrices of integers held as doubles, exact: as int64, or as Python integers where that is too small."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if most < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = [np.array([[int(v) for v in row] for row in m.tolist()], object).reshape(m.shape) for m in (a, b)]
    return whole[0] @ whole[1].T
