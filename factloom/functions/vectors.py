"""Vectors as arrays of floats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """Of length 1; a null vector stays as it is."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: (x.cast("double") / F.when(norm == 0, F.lit(1.0)).otherwise(norm)).cast("float"))
