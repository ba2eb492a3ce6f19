"""Manifests of folders: what each holds, in pages, and its figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import paths
from millrace.operators.catalog import folder_tree, with_folder_ids
from millrace.operators.ranks import placed

#: fixed value: how many of a folder's first documents are recommended
RECOMMENDED = 3


def _listed(objects: DataFrame) -> DataFrame:
    """path, file_id, source_relpath, rank: the documents of each folder by name, whatever its case, then by path and id."""
    rows = objects.select(paths.parent(F.col("source_relpath")).alias("path"), "file_id", "source_relpath", F.lower(paths.basename(F.col("source_relpath"))).alias("_name"))
    return placed(rows, ["path"], ["_name", "source_relpath", "file_id"]).drop("_name")


def folder_pages(objects: DataFrame, registry: DataFrame | None = None, size: int = 1000) -> DataFrame:
    """folder_id, path_hint, part (docs or subfolders), page (from 0), items: what a folder holds, `size` items a page.

    Items have an id (file_id or folder_id) and a path, in the order of names. Folders without documents or
    subfolders have no page of these. Ids are those of the registry (path, folder_id), else made from the path. No
    task and no row holds more than a page of a folder.
    """
    tree = with_folder_ids(folder_tree(objects), registry)
    docs = _listed(objects).select("path", F.lit("docs").alias("part"), "rank", F.struct(F.col("file_id").alias("id"), F.col("source_relpath").alias("path")).alias("item"))
    kids = tree.where("path <> ''").select(F.col("parent_path").alias("path"), F.col("path").alias("_p"), "folder_id", F.lower(paths.basename(F.col("path"))).alias("_name"))
    kids = placed(kids, ["path"], ["_name", "_p"]).select("path", F.lit("subfolders").alias("part"), "rank", F.struct(F.col("folder_id").alias("id"), F.col("_p").alias("path")).alias("item"))
    paged = docs.unionByName(kids).withColumn("page", F.floor((F.col("rank") - 1) / size).cast("bigint"))
    made = paged.groupBy("path", "part", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda x: x["item"]).alias("items"))
    return made.join(tree.select("path", "folder_id"), "path").select("folder_id", F.col("path").alias("path_hint"), "part", "page", "items")


def folder_figures(objects: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """folder_id, path_hint, file_count, subfolder_count, total_bytes, latest_mtime_utc, recommended_file_ids of every folder.

    objects holds file_id, source_relpath, size_bytes and mtime_utc. The time is that of the folder's own documents, null
    without one; recommended are its first three documents by name. All of it is added up before it is
    shuffled, or comes from ranks.
    """
    tree = with_folder_ids(folder_tree(objects), registry)
    latest = objects.groupBy(paths.parent(F.col("source_relpath")).alias("path")).agg(F.max("mtime_utc").alias("latest_mtime_utc"))
    first = _listed(objects).where(F.col("rank") <= RECOMMENDED)
    first = first.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "file_id"))), lambda x: x["file_id"]).alias("recommended_file_ids"))
    return tree.join(latest, "path", "left").join(first, "path", "left").select("folder_id", F.col("path").alias("path_hint"), "file_count", "subfolder_count", "total_bytes", "latest_mtime_utc", "recommended_file_ids")


def reused_ids(registry: DataFrame) -> DataFrame:
    """folder_id, n: ids that several paths of a registry have, with which no manifest can be written."""
    return registry.groupBy("folder_id").agg(F.count_distinct("path").alias("n")).where("n > 1")
