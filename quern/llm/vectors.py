"""Vectors of a table as rows that tasks can stack."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(table: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``(id, v)``, v an array of floats: one row per id.

    Left out are rows with a null id or vector, with a null, NaN or infinite
    element, and of another length than most (of equally many, the least). Of
    an id that has several vectors the least stays. Repeated rows are one.
    """
    rows = table.select(F.col(id_column).cast("bigint").alias("id"), F.col(column).cast("array<float>").alias("v"))
    fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(fine)
    first = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (first["d"] if first else 0)).groupBy("id").agg(F.min("v").alias("v"))


def stacked(arrays, width: int | None = None) -> np.ndarray:
    """A matrix of a column of equally long Arrow lists."""
    if not len(arrays):
        return np.zeros((0, width or 1), np.float32)
    flat = arrays.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    return flat.reshape(len(arrays), -1)
