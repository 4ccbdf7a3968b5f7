"""Vector arithmetic on ``array<float|double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null when either vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def scale_to_unit(a: Column) -> Column:
    """L2-normalised vector; a zero vector stays as it is."""
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda x: x.cast("double") / length)).otherwise(
        a.cast("array<double>")
    )


def blend(a: Column, b: Column) -> Column:
    """Unit vector of the element-wise mean of two vectors; the first alone if the second is missing."""
    mean = F.zip_with(a, b, lambda x, y: (x.cast("double") + y.cast("double")) / 2)
    return F.when(b.isNull(), a.cast("array<double>")).otherwise(scale_to_unit(mean))
