"""What the operators on embeddings share: which vectors count, and their components as integers in a matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers; a vector without components is usable."""
    finite = lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))  # noqa: E731  NaN is the largest number
    return F.coalesce(F.forall(vector, finite), F.lit(False))


def quantised(vectors: DataFrame, factor: int, *keep: str) -> DataFrame:
    """The columns to keep and x, floor(factor * component) of each usable vector; others go, further columns too."""
    x = F.transform(vectors["embedding"], lambda c: F.floor(c.cast("double") * factor))
    return vectors.where(usable(vectors["embedding"])).select(*(vectors[k] for k in keep), x.alias("x"))


def extent(points: DataFrame) -> tuple[int, int, int]:
    """The number of rows, the length of their x and the largest magnitude in them; different lengths raise."""
    largest = F.greatest(F.abs(F.array_max("x")), F.abs(F.array_min("x")))
    r = points.agg(F.count(F.lit(1)), F.min(F.size("x")), F.max(F.size("x")), F.max(largest)).first()
    if r[0] and r[1] != r[2]:
        raise ValueError(f"vectors have from {r[1]} to {r[2]} components")
    return r[0], r[1] or 0, r[3] or 0


def matrix(column: pa.ListArray, length: int) -> np.ndarray:
    """Vectors of one length as the rows of a matrix of longs."""
    return column.flatten().to_numpy().reshape(len(column), length)
