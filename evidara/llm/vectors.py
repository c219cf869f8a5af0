"""Vector columns as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def valid_vectors(table: DataFrame, zero_too: bool) -> DataFrame:
    """vec_id, embedding (array<double>): one row per vec_id (the smallest of those that repeat it), without null ids and vectors
    that are null, empty, or hold null or non-finite components; zero vectors only if zero_too."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    good = table.select(F.col("vec_id").cast("long"), v.alias("embedding")).filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).filter(~bad)
    if not zero_too:
        good = good.filter(F.exists("embedding", lambda x: x != 0))
    return good.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column whose rows all have dim elements, as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def dimensions(vectors: DataFrame) -> list[int]:
    """The lengths that occur; vectors of different lengths are searched apart."""
    return sorted(r[0] for r in vectors.select(F.size("embedding")).distinct().collect())
