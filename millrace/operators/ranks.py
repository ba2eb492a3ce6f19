"""Places of rows in the order of their scope, however large a scope is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import materialize


def placed(rows: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """The rows and rank (from 1): their place in the order of their scope.

    No task holds a whole scope. Rows are dealt into ranges of scope and order, whose bounds Spark takes
    from a sample, and written; how many rows of a scope come before a range follows from the counts of
    ranges, and a window numbers those inside. Equal rows share a range and get places one after another.
    Null scopes are a scope, null orders come first; an empty table gives an empty one.
    """
    dealt = materialize(rows.repartitionByRange(*scope, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(*scope, "_range").agg(F.count(F.lit(1)).alias("_n"))
    # a row for each scope of a range: about as many as scopes and ranges together
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(*scope).orderBy("_range")) - F.col("_n")).drop("_n")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*scope, "_range"]]
    met = dealt.alias("r").join(before.alias("b"), reduce(lambda x, y: x & y, same)).select("r.*", "_before")
    inside = F.row_number().over(Window.partitionBy(*scope, "_range").orderBy(*order))
    return met.withColumn("rank", (inside + F.col("_before")).cast("bigint")).drop("_range", "_before")
