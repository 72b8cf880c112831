"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickerloom.functions.binding import let


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    squares = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return F.sqrt(squares)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null when a vector has no length."""
    return let(norm(a) * norm(b), lambda size: F.when(size > 0, dot(a, b) / size))


def unit(a: Column) -> Column:
    """The vector at length 1; null when it has none."""
    return let(norm(a), lambda size: F.when(size > 0, F.transform(a, lambda x: x.cast("double") / size)))
