"""Summaries that put several tables of the corpus together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import paths
from millrace.functions.text import ordered_text, snippet
from millrace.operators.ranks import placed


def object_summaries(objects: DataFrame, members: DataFrame, segments: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row an object: MIME type, preview, segments, collections by name; star joins on keys."""
    from millrace.operators.catalog import collections_of_files

    n = segments.groupBy(key).agg(F.count(F.lit(1)).alias("n_segments"))
    return objects.join(n, key, "left").join(collections_of_files(members), "file_id", "left").select(
        key, "file_id", paths.mime(F.col("source_relpath")).alias("mime"), snippet(F.col("text"), 240).alias("preview"), F.coalesce("n_segments", F.lit(0)).alias("n_segments"), F.coalesce("collections", F.lit("")).alias("collections")
    )


def paged(rows: DataFrame, scope: list[str], order: list[str], size: int = 1000) -> DataFrame:
    """The rows with their place in their scope (rank, from 1) and page (from 0); no task sorts a whole scope."""
    return placed(rows, scope, order).withColumn("page", F.floor((F.col("rank") - 1) / size).cast("bigint"))


def folder_overview(objects: DataFrame, syntheses: DataFrame, tree: DataFrame, folder_syntheses: DataFrame, key: str = "doc_id") -> DataFrame:
    """path, part (document or folder), name, synthesis, doc_type, quality: what a folder's overview lists.

    Documents are those with a synthesis (key, synthesis, doc_type, quality), child folders those with
    one (path, synthesis). One row each: a folder of any size is as many rows.
    """
    rows = objects.select(key, "source_relpath").join(syntheses, key)
    relpath = F.col("source_relpath")
    docs = rows.select(paths.parent(relpath).alias("path"), F.lit("document").alias("part"), paths.basename(relpath).alias("name"), "synthesis", F.coalesce("doc_type", F.lit("unknown")).alias("doc_type"), F.coalesce("quality", F.lit("default")).alias("quality"))
    kids = tree.where("path <> ''").select("path", "parent_path").join(folder_syntheses, "path")
    kids = kids.select(F.col("parent_path").alias("path"), F.lit("folder").alias("part"), F.col("path").alias("name"), "synthesis", F.lit("folder").alias("doc_type"), F.lit("default").alias("quality"))
    return docs.unionByName(kids)


def root_overview(tree: DataFrame, folder_syntheses: DataFrame) -> DataFrame:
    """path, synthesis, kind, quality, folder_count: the top folders that have a synthesis (path, synthesis)."""
    n = tree.agg(F.count(F.lit(1)).alias("folder_count"))
    rows = tree.where("depth = 1").select("path").join(folder_syntheses, "path")
    return rows.join(F.broadcast(n)).select("path", "synthesis", F.lit("folder").alias("kind"), F.lit("default").alias("quality"), "folder_count")


def wiki_pages(members: DataFrame, title: str, kind: str = "collection", per_page: int = 1000) -> DataFrame:
    """scope_id, page, markdown: a wiki page of the members (scope_id, file_id, created) of each scope, in order, under a title.

    Scopes of more than per_page members have several pages, of which only the first has the heading.
    """
    listed = paged(members.withColumn("_order", F.format_string("%020d", F.col("created").cast("bigint"))), ["scope_id"], ["_order", "file_id"], per_page)
    n = members.groupBy("scope_id").agg(F.count(F.lit(1)).alias("_n"))
    lines = listed.groupBy("scope_id", "page").agg(ordered_text(F.col("rank"), F.concat(F.lit("- `"), F.col("file_id"), F.lit("`")), "\n").alias("_lines")).join(n, "scope_id")
    return lines.select("scope_id", "page", F.concat(F.when(F.col("page") == 0, wiki_head(F.lit(kind), F.col("_n"), title)).otherwise(""), F.col("_lines"), F.lit("\n")).alias("markdown"))


def wiki_head(kind: Column, n: Column, title: str) -> Column:
    return F.concat(F.lit(f"# {title}\n\nThis local baseline describes a **"), kind, F.lit("** scope containing **"), n.cast("string"), F.lit("** objects.\n\n## Members\n\n"), F.when(n == 0, "_No members._\n").otherwise(""))


def described_scopes(tree: DataFrame, collections: DataFrame) -> DataFrame:
    """scope_type, scope_id, label of the root, every folder and every collection."""
    root = tree.sparkSession.range(1).select(F.lit("root").alias("scope_type"), F.lit("root").alias("scope_id"), F.lit("root").alias("label"))
    folders = tree.select(F.lit("folder").alias("scope_type"), F.col("path").alias("scope_id"), F.when(F.col("path") == "", "root-folder").otherwise(F.col("path")).alias("label"))
    return root.unionByName(folders).unionByName(collections.select(F.lit("collection").alias("scope_type"), F.col("collection_id").alias("scope_id"), F.coalesce("name", "collection_id").alias("label")))


def source_states(objects: DataFrame, states: DataFrame) -> DataFrame:
    """file_id, status (active by default) and the path that holds: that of the state, else of the object."""
    s = states.select("file_id", "status", F.col("source_relpath").alias("_moved"))
    return objects.select("file_id", "source_relpath").join(s, "file_id", "left").select("file_id", F.coalesce("status", F.lit("active")).alias("status"), F.coalesce(F.expr("nullif(_moved, '')"), F.col("source_relpath")).alias("source_relpath"))


def unusable_inputs(texts: DataFrame, most_chars: int = 50_000, key: str = "doc_id") -> DataFrame:
    """key, problem of texts that an embedding service refuses: blank ones and very long ones."""
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    return texts.select(key, F.when(blank, "blank").when(F.length("text") > most_chars, "too long").alias("problem")).where("problem IS NOT NULL")
