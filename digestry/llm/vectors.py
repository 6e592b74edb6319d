"""Vectors of whole numbers: ``floor(256 x)`` of every component, for exact sums and ties."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256
#: Whole components stop at this size, so that sums over a vector always fit in 64 bits.
LIMIT = 1 << 27


def finite(vector: str) -> Column:
    """Whether a vector is there and every component is a finite number."""
    parts = F.col(vector).cast("array<double>")
    good = F.forall(
        parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return F.coalesce(good, F.lit(False))


def whole(vector: str, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of every component, as ints."""
    return F.transform(
        F.col(vector).cast("array<double>"),
        lambda x: F.floor(
            F.least(F.greatest(x * scale, F.lit(-float(LIMIT))), F.lit(float(LIMIT)))
        ).cast("int"),
    )


def width_of_first(rows: DataFrame, *order: Column) -> int:
    """The length of ``v`` in the first row of an order; 0 without rows."""
    first = rows.orderBy(*order).select(F.size("v").alias("n")).limit(1).collect()
    return first[0]["n"] if first else 0


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of one length as the rows of a matrix of 64-bit numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)
