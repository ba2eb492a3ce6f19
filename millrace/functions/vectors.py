"""Vector expressions over array<float> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(a: Column) -> Column:
    """Of length 1; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def toy_embedding(text: Column, size: int = 8) -> Column:
    """A deterministic stand-in for an embedding model: bytes of the text's SHA-256, scaled, of length 1."""
    digest = F.sha2(text, 256)
    byte = lambda i: F.conv(F.substring(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("double")
    return normalized(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (byte(i) - 127.5) / 127.5))
