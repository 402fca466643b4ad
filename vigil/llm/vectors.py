"""Helpers of the operators on vectors: checked rows, equal vectors as one row,
and packing of array columns for numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def usable(vec: Column) -> Column:
    """Whether a vector is there, not empty and of finite numbers only."""
    low, high = F.lit(float("-inf")), F.lit(float("inf"))
    return F.coalesce((F.size(vec) > 0) & F.forall(
        vec, lambda x: x.isNotNull() & ~F.isnan(x) & (x > low) & (x < high)), F.lit(False))


def smallest_ids(rows: DataFrame, same: list[str], id_col: str, keep: int) -> DataFrame:
    """One row per value of ``same`` with ``ids``, its ``keep`` smallest ids in
    order. A rank limit, which Spark also applies before the shuffle, bounds what
    a vector with very many copies sends."""
    w = W.partitionBy(*same).orderBy(id_col)
    return (rows.select(*same, id_col).distinct().withColumn("nth", F.row_number().over(w))
            .filter(F.col("nth") <= keep)
            .groupBy(*same).agg(F.sort_array(F.collect_list(id_col)).alias("ids")))


def matrix(column: pa.Array | pa.ChunkedArray, dtype=np.float64) -> np.ndarray:
    """An array column whose rows have one length, as rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0), dtype)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(dtype, copy=False)


def arrays(rows: list, kind: pa.DataType) -> pa.Array:
    return pa.array(rows, pa.list_(kind))
