"""Vectors in Arrow columns, checked and read as numpy rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def usable(column: pa.Array) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """The length of each vector (0 where it is null, zero, or holds null or non-finite
    components), and by length the rows that have it."""
    column = column.cast(pa.list_(pa.float64()))
    size = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
    by_size: dict[int, np.ndarray] = {}
    for length in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == length)
        picked = column.take(pa.array(rows)).flatten()
        values = np.asarray(pc.fill_null(picked, float("nan"))).reshape(-1, length)
        good = np.isfinite(values).all(axis=1) & (values != 0).any(axis=1)
        size[rows[~good]] = 0
        if good.any():
            by_size[length] = rows[good]
    return size, by_size


def matrix(column: pa.Array, rows: np.ndarray) -> np.ndarray:
    """Those rows of a column of equally long vectors, in double precision."""
    picked = column.cast(pa.list_(pa.float64())).take(pa.array(rows)).flatten()
    return np.asarray(picked).reshape(len(rows), -1)


def packed(values: np.ndarray) -> pa.Array:
    """Rows of doubles as binary values."""
    values = np.ascontiguousarray(values, dtype=np.float64)
    edges = (np.arange(len(values) + 1) * values.shape[1] * 8).astype(np.int32)
    return pa.Array.from_buffers(
        pa.binary(), len(values), [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(values.tobytes())]
    )


def unpacked(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Binary values of equally many doubles as rows."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)
