"""Vectors as whole numbers, for results that no order of summation can change."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), F.lit(False))
    return F.col(vector).isNotNull() & F.forall(vector, finite)


def whole(vector: str, scale: int) -> Column:
    """Each component x as floor(scale * x)."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def largest(vector: str, scale: int) -> Column:
    """The largest size of a component of ``whole``, as a double that is never less."""
    return F.aggregate(vector, F.lit(0.0), lambda most, x: F.greatest(most, F.abs(x.cast("double")) * scale + 1))


def dense(lists: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of whole numbers as rows of a matrix, zeros after the shorter ones."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out
