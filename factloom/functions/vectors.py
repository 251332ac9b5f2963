"""Vectors as arrays of floats."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_DIMENSIONS = 16384


def dot(a: Column, b: Column) -> Column:
    """Products in double, summed from the left."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def is_valid(a: Column) -> Column:
    """Not empty, not too long, all finite, of a length above 0."""
    finite = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.size(a).between(1, MOST_DIMENSIONS) & finite & (norm(a) > 0), F.lit(False))


def unit(a: Column) -> Column:
    """The vector divided by its length, rounded to float; stored with the embeddings, so scoring is a dot product."""
    return F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: (x.cast("double") / n).cast("float")))[0]


def checked(values: list[float]) -> list[float]:
    """The same test for a vector that the driver holds: ValueError if it fails."""
    if not 1 <= len(values) <= MOST_DIMENSIONS:
        raise ValueError(f"a vector has 1 to {MOST_DIMENSIONS} dimensions")
    if not all(isinstance(x, (int, float)) and math.isfinite(x) for x in values):
        raise ValueError("a vector's values must be finite")
    if not math.fsum(x * x for x in values) > 0:
        raise ValueError("a vector must not be zero")
    return [float(x) for x in values]
