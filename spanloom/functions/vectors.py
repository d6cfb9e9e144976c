"""Vector arithmetic on array columns, computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def squared_norm(a) -> Column:
    return F.aggregate(
        _col(a), F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")
    )


def unit(a) -> Column:
    """Vector scaled to length one; a zero vector stays zero.

    The norm is handed to ``finish`` so that it is computed once per vector.
    """
    a = _col(a)
    return F.aggregate(
        a,
        F.lit(0.0),
        lambda total, x: total + x.cast("double") * x.cast("double"),
        lambda total: F.transform(
            a, lambda x: F.when(total > 0, x.cast("double") / F.sqrt(total)).otherwise(F.lit(0.0))
        ),
    )


def cosine(a, b) -> Column:
    """Cosine of two vectors; 0 when either has no length."""
    lengths = F.sqrt(squared_norm(a)) * F.sqrt(squared_norm(b))
    return F.when(_col(a).isNotNull() & _col(b).isNotNull(),
                  F.when(lengths > 0, dot(a, b) / lengths).otherwise(F.lit(0.0)))
