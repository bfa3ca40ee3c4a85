"""Column expressions that several operators use; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def argmax(values: Column) -> Column:
    """Number (from 0) of the first largest element."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def total(values: Column) -> Column:
    """Sum of an array."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def normalised(values: Column) -> Column:
    """An array of non-negative numbers divided by its sum; all zeros become equal shares."""
    s = total(values)
    return F.when(s > 0, F.transform(values, lambda v: v / F.greatest(s, F.lit(1e-10)))).otherwise(F.transform(values, lambda v: 1.0 / F.size(values)))


def pearson(x: Column, y: Column) -> Column:
    """Correlation as an aggregate; 0 where a side is constant."""
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.when((F.max(x) == F.min(x)) | (F.max(y) == F.min(y)), 0.0).otherwise(F.coalesce(r, F.lit(0.0)))
