"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def is_usable(a: Column, dim: int | None = None) -> Column:
    ok = a.isNotNull() & (F.size(a) > 0) & F.forall(a, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & (norm(a) > 0)
    return ok & (F.size(a) == dim) if dim else ok


def prefix_unit(a: Column, dims: int) -> Column:
    """The first ``dims`` values at length one; null where that can't be."""
    p = F.slice(a, 1, dims)
    n = norm(p)
    return F.when((n > 0) & ~F.isnan(n), F.transform(p, lambda v: v.cast("double") / n))
