"""Vectors as arrays of numbers, computed in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product; vectors of different length give null."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine_raw(a: Column | str, b: Column | str) -> Column:
    """Cosine; 0 for missing, empty, zero or differently long vectors."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def cosine_unit(a: Column | str, b: Column | str) -> Column:
    """(cosine + 1) / 2 within 0..1; null where vectors can't be compared."""
    cos = F.when((F.size(a) > 0) & (F.size(a) == F.size(b)), F.try_divide(dot(a, b), norm(a) * norm(b)))
    return F.when(cos.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cos + 1) / 2)))


def l2_normalised(a: Column | str) -> Column:
    length = norm(a)
    return F.transform(a, lambda x: F.when(length == 0, x.cast("double")).otherwise(x / length))
