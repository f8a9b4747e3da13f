"""What operators 12 and 13 share: which vectors count, and exact integer distances."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(vector: str) -> Column:
    """True if a vector is there and none of its components is null or not finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(F.col(vector).cast("array<double>"), bad), F.lit(False))


def scaled(vector: str, factor: int) -> Column:
    """Components as integers, floor(factor * x)."""
    return F.transform(F.col(vector).cast("array<double>"), lambda x: F.floor(x * F.lit(float(factor))).cast("long"))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of vectors of one length as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def safe(points: np.ndarray, entries: np.ndarray, limit: int) -> bool:
    """Whether squared distances of integer vectors stay below ``limit`` whatever the order of sums."""
    most = max((int(np.abs(x).max()) for x in (points, entries) if x.size), default=0)
    return points.shape[1] * (2 * most) ** 2 < limit


def column_sums(points: np.ndarray) -> list[int]:
    """Sums by component as Python integers, exact for any number of rows and any size."""
    if points.size and int(np.abs(points).max()) * len(points) >= 1 << 62:
        points = points.astype(object)
    return points.sum(axis=0).tolist()
