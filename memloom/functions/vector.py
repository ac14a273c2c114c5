"""Vector expressions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def leading(a: Column, dims: int) -> Column:
    """The first dimensions, scaled to unit length."""
    part = F.slice(a, 1, dims)
    # The lambda names the length, so it is made once a row.
    both = F.array(F.struct(part.alias("x"), norm(part).alias("n")))
    return F.element_at(F.transform(both, lambda b: F.transform(b["x"], lambda x: x.cast("double") / b["n"])), 1)
