"""Vector algebra on ``array`` columns, computed in double precision.

A zero vector has norm 0, normalises to itself and has cosine 0 with everything; null stays null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column | str) -> Column:
    return F.col(v).cast("array<double>") if isinstance(v, str) else v.cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product; null when either side is null or the lengths differ."""
    products = F.zip_with(doubles(a), doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda acc, x: acc + x * x))


def unit(v: Column | str) -> Column:
    """L2-normalised vector; a zero vector is divided by one and stays zero."""
    length = norm(v)
    divisor = F.when(length == 0.0, F.lit(1.0)).otherwise(length)
    # Repeated once per row; inside a lambda it would be computed for every component.
    return F.zip_with(doubles(v), F.array_repeat(divisor, F.size(doubles(v))), lambda x, d: x / d)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity, 0 where a side has no length."""
    lengths = norm(a) * norm(b)
    return F.when(lengths == 0.0, F.lit(0.0)).otherwise(dot(a, b) / F.when(lengths == 0.0, F.lit(1.0)).otherwise(lengths))


def masked_mean(hidden: Column | str, mask: Column | str, dim: int) -> Column:
    """The mean of the token rows whose mask is 1; zeros where there is none."""
    h, m = (F.col(x) if isinstance(x, str) else x for x in (hidden, mask))
    kept = F.filter(F.arrays_zip(h.alias("h"), m.alias("m")), lambda s: s["m"] == 1)
    n = F.size(kept)
    total = F.aggregate(kept, F.array(*[F.lit(0.0)] * dim), lambda a, s: F.zip_with(a, s["h"], lambda x, y: x + y))
    return F.zip_with(total, F.array_repeat(F.when(n == 0, F.lit(1)).otherwise(n), F.lit(dim)), lambda x, d: x / d)


def first_token(hidden: Column | str) -> Column:
    return F.element_at(F.col(hidden) if isinstance(hidden, str) else hidden, 1)
