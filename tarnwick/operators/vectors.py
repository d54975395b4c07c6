"""Vector columns: norms, normalising, inner products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def norm(v: Column) -> Column:
    """L2 norm, summed in double by index."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """Divided by its norm; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / n))


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dimension(vectors: DataFrame, column: str = "embedding") -> int | None:
    """The width all vectors share; an error if they differ, None without vectors."""
    low, high = vectors.agg(F.min(F.size(column)), F.max(F.size(column))).head()
    if low != high:
        raise ValueError(f"vectors of {low} to {high} dimensions")
    return low
