"""Vector functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """1 - cosine; 2 for a zero vector. Norms may be given to save work; lengths that differ are an error."""
    na = norm(a) if norm_a is None else norm_a
    nb = norm(b) if norm_b is None else norm_b
    distance = F.when((na == 0) | (nb == 0), F.lit(2.0)).otherwise(1 - dot(a, b) / (na * nb))
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different lengths"))).otherwise(distance)


def hash_vector(text: Column, dims: int) -> Column:
    """A unit vector made of the digests of the text and each index."""
    raw = F.transform(
        F.sequence(F.lit(0), F.lit(dims - 1)),
        lambda i: F.conv(F.substring(F.sha2(F.concat_ws(" ", text, i.cast("string")), 256), 1, 4), 16, 10).cast("double") / 32768 - 1,
    )
    length = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(raw, lambda x: x / length)
