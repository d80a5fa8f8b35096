"""Vectors with integer components: floor(256 * x), for exact distances and inner products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components beyond this are no vector of this module: within it all sums of products fit in 64 bits.
LARGEST = 65536.0


def integer_rows(rows: DataFrame, *keep: F.Column, vector: str = "embedding") -> DataFrame:
    """The columns ``keep`` and v array<int> of rows whose vector is there, finite and within ±LARGEST."""
    x = F.col(f"`{vector}`").cast("array<double>")
    good = (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & (F.abs(c) <= LARGEST))  # not a number is larger than any
    return rows.where(F.coalesce(good, F.lit(False))).select(*keep, F.transform(x, lambda c: F.floor(c * 256).cast("int")).alias("v"))


def of_usual_length(rows: DataFrame) -> tuple[DataFrame, int]:
    """Rows whose v has the number of components that most have (of equally many, the larger number), and that number; 0 if there are none."""
    most = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.col("count").desc(), F.col("size").desc()).limit(1).collect()
    size = most[0]["size"] if most else 0
    return rows.where(F.size("v") == size), size


def matrix(col: pa.Array, dtype=np.int64) -> np.ndarray:
    """A list column of equal lengths as rows."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    return col.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(n, -1) if n else np.empty((0, 0), dtype)
