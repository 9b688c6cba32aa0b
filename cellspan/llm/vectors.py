"""Vectors of an array column as numpy matrices, for the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(F.forall(vector, fine), F.lit(False))


def dimensions(vectors: DataFrame, column: str) -> int:
    """The length of the longest vector; shorter ones count as followed by zeros."""
    return vectors.agg(F.coalesce(F.max(F.size(column)), F.lit(0))).first()[0]


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The vectors (none null) as rows of doubles, zeros where one is shorter."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    cuts, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dims))
    size = np.diff(cuts)
    if (size == dims).all():
        out[:] = flat[cuts[0] : cuts[-1]].reshape(len(column), dims) if dims else 0
    else:
        row = np.repeat(np.arange(len(column)), size)
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[row, at] = flat[cuts[0] : cuts[-1]]
    return out
