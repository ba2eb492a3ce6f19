"""Checks of tables that users write: routes, artifact tables, responses and parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import strip


def route_problems(routes: DataFrame, extractors: DataFrame) -> DataFrame:
    """ord, level, problem of ordered routes (ord, name, extractor, extensions) against a registry (id, enabled).

    Routes are a small table by nature: its windows over the order of all routes hold what a user wrote.
    """
    order = Window.partitionBy(F.lit(0)).orderBy("ord")
    lowered = F.transform(F.filter("extensions", lambda e: strip(e) != ""), lambda e: F.lower(strip(e)))
    r = routes.join(extractors.select(F.col("id").alias("extractor"), F.coalesce("enabled", F.lit(False)).alias("enabled")), "extractor", "left").withColumn("exts", F.coalesce(lowered, F.array().cast("array<string>")))
    r = r.withColumn("_all", F.array_contains("exts", "*")).withColumn("_named", F.coalesce("name", F.lit("")) != "")
    r = r.withColumn("_twin", F.row_number().over(Window.partitionBy("name").orderBy("ord")) > 1)
    r = r.withColumn("_all_before", F.coalesce(F.max(F.col("_all").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1).withColumn("_last", F.lead("ord").over(order).isNull())
    r = r.withColumn("_listed", F.coalesce(F.size("extensions") > 0, F.lit(False)))
    found = F.array_compact(F.array(
        F.when(~F.col("_named"), _said("error", "no name")), F.when(F.col("_named") & F.col("_twin"), _said("error", "name is taken")),
        F.when(F.coalesce("extractor", F.lit("")) == "", _said("error", "no extractor")),
        F.when((F.coalesce("extractor", F.lit("")) != "") & F.col("enabled").isNull(), _said("warning", "unknown extractor")), F.when(~F.col("enabled"), _said("warning", "disabled extractor")),
        F.when(~F.col("_listed"), _said("error", "no extensions")), F.when(F.exists(F.coalesce("extensions", F.array().cast("array<string>")), lambda e: strip(e) == ""), _said("error", "blank extension")),
        F.when(F.exists("exts", lambda e: (e != "*") & ~e.startswith(".")), _said("error", "extension without a dot")),
        F.when(F.col("_all") & F.col("_all_before"), _said("error", "second catch-all")), F.when(F.col("_all") & ~F.col("_last"), _said("warning", "catch-all is not last")),
        F.when(F.col("_listed") & F.col("_all_before") & ~F.col("_all"), _said("warning", "after a catch-all")),
    ))
    own = r.select("ord", F.explode(found).alias("p")).select("ord", "p.level", "p.problem")
    each = r.select("ord", F.explode("exts").alias("ext")).where("ext <> '*'")
    again = each.withColumn("_k", F.row_number().over(Window.partitionBy("ext").orderBy("ord"))).where("_k > 1")
    return own.unionByName(again.select("ord", F.lit("warning").alias("level"), F.concat(F.lit("matched earlier: "), F.col("ext")).alias("problem")))


def _said(level: str, problem: str) -> Column:
    return F.struct(F.lit(level).alias("level"), F.lit(problem).alias("problem"))


def table_problems(tables: DataFrame, key: str) -> DataFrame:
    """key, problem of artifact tables (columns, n_rows, n_provenance): repeated column keys, provenance of some rows only."""
    twice = F.size(F.array_distinct("columns")) < F.size("columns")
    partly = (F.col("n_provenance") > 0) & (F.col("n_provenance") != F.col("n_rows"))
    problems = F.array_compact(F.array(F.when(twice, "repeated column key"), F.when(partly, "provenance of some rows only")))
    return tables.select(key, F.explode(problems).alias("problem"))


def response_problems(responses: DataFrame, key: str = "vec_id", column: str = "embedding", dims: int | None = None) -> DataFrame:
    """key, problem of vectors that a service returned: missing, empty, of another length than the first, not numbers."""
    v = F.col(column)
    size = F.lit(dims) if dims else F.lit(responses.select(F.min_by(F.size(column), key)).first()[0])
    problem = F.when(v.isNull(), "missing").when(F.size(v) == 0, "empty").when(F.size(v) != size, "another length").when(F.exists(v, lambda x: x.isNull() | F.isnan(x)), "not a number")
    return responses.select(key, problem.alias("problem")).where("problem IS NOT NULL")


def odd_kernel(size: Column, least: int = 1) -> Column:
    """An image filter's size: at least `least`, and odd (the next greater one)."""
    n = F.greatest(size, F.lit(least))
    return F.when(n % 2 == 0, n + 1).otherwise(n)
