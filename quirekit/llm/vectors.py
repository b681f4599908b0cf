"""Vectors as whole numbers: reading, exact squared distances, bounds that rounding can't break, sums by group."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units of one, before the floor.
SCALE = 256


def limit(dims: int) -> int:
    """The largest component kept as it is: squared distances of vectors within it stay below 2**62."""
    return 1 << ((62 - max(dims - 1, 0).bit_length()) // 2 - 1)


def usable(column: str) -> Column:
    """Whether a vector is there and all of its components are finite."""
    x = F.col(column)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    return x.isNotNull() & F.coalesce(fine, F.lit(False))


def whole(column: str, dims: int) -> Column:
    """floor(SCALE * x) of each component as an int, held within ``limit``."""
    most = float(limit(dims))
    return F.transform(F.col(column), lambda v: F.least(F.greatest(F.floor(v.cast("double") * F.lit(float(SCALE))).cast("double"), F.lit(-most)), F.lit(most)).cast("int"))


def matrix(column, dims: int) -> np.ndarray:
    """A list or binary column of int32 as rows x dims of int64."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return bytes_matrix(column, np.int32, dims).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)


def bytes_matrix(column, kind, width: int) -> np.ndarray:
    """A binary column whose values hold ``width`` numbers each."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def binary(rows: np.ndarray) -> pa.Array:
    """Each row of a matrix as one binary value."""
    rows = np.ascontiguousarray(rows)
    return pa.array([r.tobytes() for r in rows], pa.binary())


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x to rows of c, as int64."""
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]


def above(x: np.ndarray) -> np.ndarray:
    """A number that is certainly no less than the square root's or sum's true value."""
    return np.nextafter(np.nextafter(np.asarray(x, np.float64), np.inf), np.inf)


def below(x: np.ndarray) -> np.ndarray:
    """A number that is certainly no more, 0 at least."""
    return np.maximum(np.nextafter(np.nextafter(np.asarray(x, np.float64), -np.inf), -np.inf), 0.0)


def floored(sums: np.ndarray, counts: np.ndarray, old: np.ndarray) -> np.ndarray:
    """Componentwise floor(sum / count); what has no members stays."""
    return np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], old)


def summed(members: DataFrame, groups: list[str], width: int) -> list:
    """Rows (groups..., n, s0, s1, ...) of a few partial sums (groups..., n, s) a task; as many rows as there are groups."""
    return members.groupBy(*groups).agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(width)]).collect()


def digest(values: np.ndarray) -> str:
    """SHA-256 of the decimal values, comma-joined."""
    return hashlib.sha256(",".join(map(str, values.ravel().tolist())).encode()).hexdigest()
