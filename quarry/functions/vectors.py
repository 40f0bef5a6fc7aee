"""Vector math on ARRAY<DOUBLE> columns (V1, V2) with higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(c) -> Column:
    return _c(c).cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0).cast("double"), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(F.transform(_c(a), lambda x: x * x), F.lit(0.0).cast("double"), lambda s, x: s + x))


def cosine(a, b) -> Column:
    """V1: 0.0 on length mismatch or zero norm."""
    na, nb = norm(a), norm(b)
    return (
        F.when(F.size(_c(a)) != F.size(_c(b)), F.lit(0.0))
        .when((na == 0) | (nb == 0), F.lit(0.0))
        .otherwise(dot(a, b) / (na * nb))
    )


def normalize(a) -> Column:
    """V2: unit length; zero vectors unchanged."""
    n = norm(a)
    return F.when(n == 0, _c(a)).otherwise(F.transform(_c(a), lambda x: x / n))
