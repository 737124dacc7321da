"""Vectors in array columns: which count as whole, and their rows as matrices in a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are numbers: no null, NaN or infinity. Never null."""
    fine = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return F.coalesce(fine, F.lit(False))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column of longs as int64, rows x width; shorter lists end in zeros. No list may be longer than `width`."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy()
    size = np.diff(offsets)
    if len(size) and (size == width).all():
        return values[offsets[0] : offsets[-1]].reshape(-1, width)
    out = np.zeros((len(size), width), dtype=np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(row)) - np.repeat(offsets[:-1] - offsets[0], size)] = values[offsets[0] : offsets[-1]]
    return out
