"""Embedding tables: which vectors take part, and matrices of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(table: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id long, v array<double> of the vectors that take part: not null, of the commonest length (of equally common
    ones the longest), all components finite, one at least not zero; null ids take no part."""
    v = F.col(vector).cast("array<double>")
    rows = table.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(finite & F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (size["n"] if size else 0))


def matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of equal-length lists as a matrix."""
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64, copy=False)


def lists(rows: np.ndarray) -> pa.ListArray:
    width = rows.shape[1] if rows.ndim == 2 else 0
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * width, pa.int32()), pa.array(rows.ravel()))


def products(rows: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Inner products that equal rows share to the last bit, wherever they stand."""
    return (rows * vector).sum(axis=1)
