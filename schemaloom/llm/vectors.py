"""Vectors as Spark hands them over: which take part, and how they travel (little-endian bytes)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid(v: Column) -> Column:
    """Not null, not zero, without null or non-finite components."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def element(df: DataFrame, column: str) -> str:
    """The numpy type in which a vector column travels: that of its elements."""
    kind = df.schema[column].dataType.elementType.simpleString()
    return "<f4" if kind == "float" else "<f8"


def matrix(col: pa.Array, kind: str = "<f8") -> np.ndarray:
    """A list column of equally long vectors as a matrix."""
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(col), -1) if len(col) else np.empty((0, 0), kind)


def stacked(blobs, kind: str) -> np.ndarray:
    """Packed vectors as a matrix of doubles."""
    return np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1).astype(np.float64)


def levelled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two of their own, so that squares of very small or large components neither vanish nor overflow; directions stay exact."""
    _, e = np.frexp(np.abs(x).max(1, keepdims=True))
    return np.ldexp(x, -e)


def unit(x: np.ndarray) -> np.ndarray:
    x = levelled(x) if x.size else x
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row in double precision; the same rows give the same value wherever they stand."""
    if a.size and b.size:
        a, b = levelled(a), levelled(b)
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))
