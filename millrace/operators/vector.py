"""Exact vector search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.vectors import dot, norm, normalized


def unit_vectors(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    return vectors.withColumn(column, normalized(F.col(column)))


def scored_vectors(vectors: DataFrame, query: list[float], column: str = "embedding") -> DataFrame:
    """The other columns and score: the inner product with the query, which is a literal of the scan."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.withColumn("score", dot(F.col(column), q)).drop(column)


def nearest(vectors: DataFrame, query: list[float], top_k: int = 10, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The top_k rows by inner product with the query, best first; ties by key: a scan with a partial top-k in each task."""
    return scored_vectors(vectors, query, column).orderBy(F.desc(F.round("score", 9)), key).limit(top_k)


def bad_vectors(vectors: DataFrame, dims: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Rows that can't be searched: of another length, not finite, or with a repeated key."""
    bad = (F.size(column) != dims) | F.exists(column, lambda x: F.isnan(x) | x.isNull()) | (norm(F.col(column)) == 0)
    again = vectors.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key, F.lit("repeated").alias("problem"))
    return vectors.where(bad).select(key, F.lit("unusable").alias("problem")).unionByName(again)
