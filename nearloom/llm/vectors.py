"""Which vectors take part in a search, and Arrow access to them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: str | Column) -> Column:
    """True for a vector that is not null, not empty, not zero and holds only finite numbers."""
    v = F.col(vector) if isinstance(vector, str) else vector
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    good = (F.size(v) > 0) & F.forall(v, number) & F.exists(v, lambda x: F.coalesce(x != 0, F.lit(False)))
    return F.coalesce(v.isNotNull() & good, F.lit(False))


def common_size(vectors: DataFrame, vector: str) -> tuple[int, int]:
    """The most frequent length of the vectors, the shorter on a tie, and how many have it; (0, 0) if there are none."""
    row = (
        vectors.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()
    )
    return (row["d"], row["count"]) if row else (0, 0)


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """A list column without nulls as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
