"""Collections as a table: created, changed, deleted and found in batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import strip


def collection_id(name: Column) -> Column:
    """An id that depends on nothing but the name, which is unique."""
    return F.concat(F.lit("col-"), F.left(F.sha2(name, 256), F.lit(12)))


def checked_names(existing: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (ord, name, ...) with names trimmed and a problem: no name, or one that is taken or was asked for earlier."""
    trimmed = asked.withColumn("name", strip(F.coalesce("name", F.lit(""))))
    taken = existing.select("name").distinct().withColumn("_taken", F.lit(True))
    first = trimmed.groupBy("name").agg(F.min("ord").alias("_first"))
    problem = F.when(F.col("name") == "", "name is required").when(F.col("_taken").isNotNull() | (F.col("ord") > F.col("_first")), "name is taken")
    return trimmed.join(taken, "name", "left").join(first, "name").withColumn("problem", problem).drop("_taken", "_first")


def created(existing: DataFrame, asked: DataFrame, now: Column) -> DataFrame:
    """The collections after those asked for (ord, name, description, kind, color) were created; rows with a problem aren't."""
    good = checked_names(existing, asked).where("problem IS NULL")
    kind = F.coalesce(F.nullif(strip(F.col("kind")), F.lit("")), F.lit("manual"))
    rows = good.select(collection_id(F.col("name")).alias("collection_id"), "name", "description", kind.alias("kind"), "color", now.alias("created"), now.alias("updated"))
    return existing.select(*rows.columns).unionByName(rows)


def updated(existing: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """The collections after changes (collection_id, name, description, kind, color), one a collection.

    A null leaves a field as it is and a change of nothing leaves the time; a blank kind is 'manual', a
    blank name changes nothing at all. Changes of unknown collections are ignored.
    """
    fields = ("name", "description", "kind", "color")
    c = changes.select("collection_id", *[F.col(f).alias(f"_{f}") for f in fields])
    blank = F.col("_name").isNotNull() & (strip(F.col("_name")) == "")
    asked = ~blank & F.coalesce(*[F.when(F.col(f"_{f}").isNotNull(), True) for f in fields], F.lit(False))
    new = {"name": strip(F.col("_name")), "kind": F.when(F.col("_kind").isNotNull(), F.coalesce(F.nullif(strip(F.col("_kind")), F.lit("")), F.lit("manual")))}
    met = existing.join(c, "collection_id", "left")
    return met.select("collection_id", *[F.when(asked, F.coalesce(new.get(f, F.col(f"_{f}")), F.col(f))).otherwise(F.col(f)).alias(f) for f in fields], "created", F.when(asked, now).otherwise(F.col("updated")).alias("updated"))


def deleted(existing: DataFrame, members: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The collections and members that are left."""
    ids = gone.select("collection_id").distinct()
    return existing.join(ids, "collection_id", "left_anti"), members.join(ids, "collection_id", "left_anti")


def found_by_name(existing: DataFrame, names: DataFrame) -> DataFrame:
    """name, collection_id of exact names; the least id where several have one."""
    hits = existing.groupBy("name").agg(F.min("collection_id").alias("collection_id"))
    return names.select("name").distinct().join(hits, "name", "left")


def records(existing: DataFrame, members: DataFrame) -> DataFrame:
    """Collections with kind 'manual' where none is given, and how many members they have."""
    n = members.groupBy("collection_id").agg(F.count(F.lit(1)).alias("document_count"))
    return existing.join(n, "collection_id", "left").withColumn("document_count", F.coalesce("document_count", F.lit(0))).withColumn("kind", F.coalesce("kind", F.lit("manual")))
