"""Vector arithmetic on array columns.

All of it runs in the JVM and sums left to right, so equal vectors give bit-equal results
whatever the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def as_double(col: Column | str) -> Column:
    return _c(col).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in double precision."""
    products = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def squared_norm(v: Column | str) -> Column:
    return F.aggregate(as_double(v), F.lit(0.0), lambda acc, x: acc + x * x)


def _bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, also when ``body`` uses it
    for every element of an array."""
    return F.element_at(F.transform(F.array(value), body), 1)


def l2_normalize(v: Column | str) -> Column:
    """Unit-length copy of ``v`` as doubles; a zero vector stays zero."""
    return _bind(
        F.sqrt(squared_norm(v)),
        lambda norm: _bind(
            F.when(norm == 0.0, F.lit(1.0)).otherwise(norm),
            lambda n: F.transform(as_double(v), lambda x: x / n),
        ),
    )


def cosine_sim(a: Column | str, b: Column | str) -> Column:
    """Inner product of the normalized vectors; 0 when either is zero."""
    scale = F.sqrt(squared_norm(a) * squared_norm(b))
    return _bind(scale, lambda s: F.when(s == 0.0, F.lit(0.0)).otherwise(dot(a, b) / s))


def cosine_dist(a: Column | str, b: Column | str) -> Column:
    return F.lit(1.0) - cosine_sim(a, b)


def l2_sq(a: Column | str, b: Column | str) -> Column:
    """Squared Euclidean distance."""
    squares = F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y))
    return F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x)
