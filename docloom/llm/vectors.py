"""Vectors as exact integers, shared by the operators that compare them without rounding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components saturate so that no squared distance of two vectors leaves 64 bits: at sqrt(SPAN / dimensions).
SPAN = 1 << 60


def finite(v: Column) -> Column:
    """False for a null vector and for one that holds null or non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return v.isNotNull() & ~F.exists(v.cast("array<double>"), bad)


def integers(v: Column, scale: int) -> Column:
    """``floor(scale * x)`` of every component; beyond the limit of ``SPAN`` (2**27 for 64 components) it saturates."""
    most = F.floor(F.sqrt(F.lit(float(SPAN)) / F.greatest(F.size(v), F.lit(1))))
    return F.transform(v.cast("array<double>"), lambda x: F.floor(F.greatest(-most, F.least(most, x * scale))).cast("int"))


def integers_sql(scale: int, column: str = "embedding") -> str:
    """The same for DuckDB."""
    most = f"floor(sqrt({SPAN} / len({column})))"
    return f"list_transform({column}, lambda x: floor(greatest(-{most}, least({most}, x::double * {scale})))::bigint)"


FINITE_SQL = "embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as the rows of an int64 matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def least(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first least column of each row, and its value."""
    at = scores.argmin(axis=1)
    return at, scores[np.arange(len(at)), at]


def sums_by(index: np.ndarray, x: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Row counts and componentwise sums of ``x`` by ``index``."""
    counts = np.bincount(index, minlength=groups)
    out = np.zeros((groups, x.shape[1]), np.int64)
    used = np.flatnonzero(counts)
    if len(used):
        starts = np.concatenate([[0], np.cumsum(counts[used])[:-1]])
        out[used] = np.add.reduceat(x[np.argsort(index, kind="stable")], starts, axis=0)
    return counts, out


def merged(partial: DataFrame, keys: list[str]) -> list:
    """Partial counts and sums ``n, s`` added up by ``keys``: one grouped shuffle of what the tasks have summed."""
    return partial.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
