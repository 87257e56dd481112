"""Vectors of whole numbers: what may be used of a column of vectors, and its components as integers."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str | Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    column = F.col(vector) if isinstance(vector, str) else vector
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(column, finite), F.lit(False))


def width(rows: DataFrame, vector: str) -> int:
    """The largest number of components; shorter vectors are read as if zeros followed."""
    return rows.agg(F.coalesce(F.max(F.size(vector)), F.lit(0))).first()[0]


def largest(dimensions: int, room: int) -> int:
    """The largest component whose squares, summed over all dimensions, stay below 2 ** room."""
    return math.isqrt((1 << room) // max(dimensions, 1))


def integers(column: pa.Array, scale: int, dimensions: int, most: int) -> np.ndarray:
    """floor(scale * x) of lists of doubles, a row each, zeros behind the shorter; components end at ``most`` either way."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = np.asarray(column.flatten(), np.float64)
    sizes = np.asarray(column.value_lengths(), np.int64)
    with np.errstate(over="ignore"):
        whole = np.clip(np.floor(values * scale), -most, most).astype(np.int64)
    if len(sizes) and (sizes == dimensions).all():
        return whole.reshape(len(sizes), dimensions)
    out = np.zeros((len(sizes), dimensions), np.int64)
    out[np.arange(dimensions) < sizes[:, None]] = whole
    return out
