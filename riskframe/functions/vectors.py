"""Vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos(a, b); NULL when one of the vectors is zero."""
    return F.lit(1.0) - F.try_divide(dot(a, b), norm(a) * norm(b))


def hashed_bag(tokens: Column, dim: int) -> Column:
    """Token counts in ``dim`` (<= 256) buckets, the bucket taken from the token's MD5."""
    buckets = F.transform(tokens, lambda t: F.conv(F.substring(F.md5(t), 1, 2), 16, 10).cast("int") % dim)
    return F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(buckets, lambda b: b == i)).cast("float")
    )
