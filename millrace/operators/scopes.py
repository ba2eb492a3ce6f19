"""Scopes: the part of a corpus that a query looks at."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.paths import inside

KINDS = ("root", "folder", "collection", "object")


@dataclass(frozen=True)
class Scope:
    """root, folder (a path), collection (an id) or object (a file id; 'document' is another name)."""

    kind: str = "root"
    id: str = ""

    def __post_init__(self):
        if self.kind == "document":
            object.__setattr__(self, "kind", "object")
        if self.kind not in KINDS:
            raise ValueError(f"unknown scope {self.kind!r}")


def in_scope(objects: DataFrame, scope: Scope, members: DataFrame | None = None) -> DataFrame:
    """The objects of a scope. The filter stands below whatever follows, so it reaches the scan; a
    collection is a semi-join with its members. Unknown folders, collections and objects hold nothing."""
    if scope.kind == "root":
        return objects
    if scope.kind == "folder":
        return objects.where(inside(F.col("source_relpath"), F.lit(scope.id)))
    if scope.kind == "object":
        return objects.where(F.col("file_id") == scope.id)
    if members is None:
        raise ValueError("a collection scope needs the members table")
    return objects.join(members.where(F.col("collection_id") == scope.id).select("file_id"), "file_id", "left_semi")


def scope_members(objects: DataFrame, scope: Scope, members: DataFrame | None = None, folders: DataFrame | None = None) -> DataFrame:
    """file_id and what its order in the scope is: of a collection when it was added and the id, else the path.

    A folder's id is looked up in folders (folder_id, path), or taken for a path without that table. What
    is unknown has no members. The order is left to whoever shows them: a scope may be the whole corpus.
    """
    if scope.kind == "collection":
        if members is None:
            raise ValueError("a collection scope needs the members table")
        return members.where(F.col("collection_id") == scope.id).select("file_id", F.struct(F.format_string("%020d", F.col("created").cast("bigint")).alias("a"), F.col("file_id").alias("b")).alias("ord"))
    if scope.kind == "folder" and folders is not None:
        found = folders.where(F.col("folder_id") == scope.id).select("path").first()
        objects = in_scope(objects, Scope("folder", found["path"])) if found else objects.where("false")
    elif scope.kind == "object":
        return objects.where(F.col("file_id") == scope.id).groupBy("file_id").agg(F.struct(F.min("source_relpath").alias("a"), F.first("file_id").alias("b")).alias("ord"))
    else:
        objects = in_scope(objects, scope, members)
    return objects.groupBy("file_id").agg(F.min("source_relpath").alias("_p")).select("file_id", F.struct(F.col("_p").alias("a"), F.col("file_id").alias("b")).alias("ord"))


def scope_texts(objects: DataFrame, scope: Scope, members: DataFrame | None = None) -> DataFrame:
    """n_members and total_chars of a scope: one row."""
    return in_scope(objects, scope, members).agg(F.count(F.lit(1)).alias("n_members"), F.coalesce(F.sum(F.length("text").cast("bigint")), F.lit(0)).alias("total_chars"))


def member_texts(members: DataFrame, preferred: DataFrame) -> DataFrame:
    """The members of scopes (file_id and what names their scope) with representation and text; members without a text are left out."""
    return members.join(preferred.select("file_id", "representation", "text"), "file_id")


def total_chars(texts: DataFrame, scope: str = "scope") -> DataFrame:
    """scope, n_texts, total_chars of the texts of members."""
    return texts.groupBy(scope).agg(F.count(F.lit(1)).alias("n_texts"), F.sum(F.length("text").cast("bigint")).alias("total_chars"))
