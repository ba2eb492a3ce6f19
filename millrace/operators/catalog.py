"""Files catalog, folder tree and collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import paths


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by order; an aggregate, so hot keys are reduced before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def files_catalog(folder_docs: DataFrame, finished: DataFrame) -> DataFrame:
    """file_id, source_relpath: folder documents and finished objects (status done or partial) together.

    Both hold file_id and source_relpath, finished also status; paths are unique in each. Folder documents
    come first, the least path of each content id; then the finished objects whose content and whose
    path none of those has, again the least path of each content id.
    """
    kept = first_seen(folder_docs.select("file_id", "source_relpath"), ["file_id"], ["source_relpath"])
    done = finished.where(F.col("status").isin("done", "partial")).select("file_id", "source_relpath")
    more = done.join(kept, "file_id", "left_anti").join(kept.select("source_relpath"), "source_relpath", "left_anti")
    return kept.unionByName(first_seen(more.select("file_id", "source_relpath"), ["file_id"], ["source_relpath"]))


def folder_tree(objects: DataFrame) -> DataFrame:
    """path, parent_path, depth, file_count, subfolder_count, total_bytes of every folder, the root ('') too."""
    parent = paths.parent(F.col("source_relpath"))
    direct = objects.groupBy(parent.alias("path")).agg(F.count(F.lit(1)).alias("file_count"), F.sum("size_bytes").alias("total_bytes"))
    every = direct.select(F.explode(paths.ancestors(F.col("path"))).alias("path")).distinct()
    children = every.where("path <> ''").groupBy(paths.parent(F.col("path")).alias("path")).agg(F.count(F.lit(1)).alias("subfolder_count"))
    joined = every.join(direct, "path", "left").join(children, "path", "left")
    return joined.select(
        "path", F.when(F.col("path") != "", paths.parent(F.col("path"))).alias("parent_path"), paths.depth(F.col("path")).alias("depth"),
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("file_count", "subfolder_count", "total_bytes")],
    )


def with_folder_ids(tree: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Folder ids: those of the registry (path, folder_id), else derived from the path."""
    own = F.concat(F.lit("folder-"), F.left(F.sha2("path", 256), F.lit(12)))
    if registry is None:
        return tree.withColumn("folder_id", own)
    return tree.join(registry.select("path", F.col("folder_id").alias("_known")), "path", "left").withColumn("folder_id", F.coalesce("_known", own)).drop("_known")


def found_by_path(asked: DataFrame, objects: DataFrame, path: str = "path") -> DataFrame:
    """The rows of asked with file_id: the object at a typed path (back slashes, blanks and slashes around it don't count), null where none is."""
    known = first_seen(objects.select(F.col("source_relpath").alias("_path"), "file_id"), ["_path"], ["file_id"])
    return asked.withColumn("_path", paths.normalize(F.col(path))).join(known, "_path", "left").drop("_path")


def folder_listing(objects: DataFrame, search: str = "") -> DataFrame:
    """path, is_file, name, processed, and sort: what a folder shows, subfolders before files, by name whatever its case.

    objects holds source_relpath and processed. search keeps the files whose name has it; subfolders are always shown.
    sort is the order in a folder, for overviews.paged.
    """
    p = F.col("source_relpath")
    files = objects.select(paths.parent(p).alias("path"), F.lit(1).alias("is_file"), paths.basename(p).alias("name"), F.coalesce("processed", F.lit(False)).alias("processed"))
    files = files.where(F.contains(F.lower("name"), F.lower(F.lit(search))))
    parent = objects.select(paths.parent(p).alias("path")).distinct()
    every = parent.select(F.explode(paths.ancestors(F.col("path"))).alias("path")).distinct().where("path <> ''")
    kids = every.select(paths.parent(F.col("path")).alias("path"), F.lit(0).alias("is_file"), paths.basename(F.col("path")).alias("name"), F.lit(None).cast("boolean").alias("processed"))
    return files.unionByName(kids).withColumn("sort", F.concat(F.col("is_file").cast("string"), F.lower("name")))


def top_nodes(nodes: DataFrame, node: str = "id", parent: str = "parent_id") -> DataFrame:
    """The rows of nodes and is_top: without a parent, or with one that isn't among them (an orphan is shown at the top)."""
    known = nodes.select(F.col(node).alias("_parent")).distinct().withColumn("_known", F.lit(True))
    return nodes.join(known, F.col(parent) == F.col("_parent"), "left").withColumn("is_top", F.col("_known").isNull()).drop("_parent", "_known")


def merged_registry(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """url, ord, origin of the services of several registries (url, ord, and enabled if it has one), the first registry first.

    Slashes at the end of a url don't count; of the same url the first registry's least ord holds. Entries that aren't
    enabled are left out; a null or missing flag is enabled.
    """
    out = None
    for i, (origin, rows) in enumerate(sources):
        on = rows.where(F.coalesce("enabled", F.lit(True))) if "enabled" in rows.columns else rows
        part = on.select(F.rtrim("url", F.lit("/")).alias("url"), F.col("ord").cast("bigint").alias("ord"), F.lit(origin).alias("origin"), F.lit(i).alias("_i"))
        out = part if out is None else out.unionByName(part)
    return first_seen(out, ["url"], ["_i", "ord"]).drop("_i")


def breadcrumbs(tree: DataFrame) -> DataFrame:
    """path, position, crumb: every ancestor of every folder, from the root."""
    return tree.select("path", F.posexplode(paths.ancestors(F.col("path"))).alias("position", "crumb"))


def duplicate_folders(folders: DataFrame) -> DataFrame:
    """Folder ids or paths that occur more than once."""
    a = folders.groupBy(F.col("folder_id").alias("value")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    b = folders.where("path <> ''").groupBy(F.col("path").alias("value")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return a.unionByName(b)


# collections ---------------------------------------------------------------------------------


def member_counts(collections: DataFrame, members: DataFrame) -> DataFrame:
    n = members.groupBy("collection_id").agg(F.count(F.lit(1)).alias("document_count"))
    return collections.join(n, "collection_id", "left").withColumn("document_count", F.coalesce("document_count", F.lit(0)))


def collections_of_files(members: DataFrame) -> DataFrame:
    """file_id, names: the collections of each file, by name."""
    names = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct(F.lower("name").alias("l"), F.col("name").alias("n")))), lambda x: x["n"]), ",")
    return members.groupBy("file_id").agg(names.alias("collections"))


def add_members(members: DataFrame, requested: DataFrame) -> DataFrame:
    """collection_id, file_id, added for a request; what it names twice counts once."""
    asked = requested.select("collection_id", "file_id").distinct()
    have = members.select("collection_id", "file_id", F.lit(True).alias("_have"))
    return asked.join(have, ["collection_id", "file_id"], "left").select("collection_id", "file_id", F.col("_have").isNull().alias("added"))


def remove_members(members: DataFrame, gone: DataFrame) -> DataFrame:
    return members.join(gone.select("collection_id", "file_id").distinct(), ["collection_id", "file_id"], "left_anti")


def resolve_members(definition: DataFrame, objects: DataFrame) -> DataFrame:
    """ord, file_id of a collection definition whose rows name a file_id or a path; unknown ones have null.

    The id wins over the path; a file that is named again counts where it was named first.
    """
    by_path = objects.select(F.lower("source_relpath").alias("_p"), F.col("file_id").alias("_by_path"))
    found = definition.withColumn("_p", F.lower(paths.normalize(F.col("source_relpath")))).join(first_seen(by_path, ["_p"], ["_by_path"]), "_p", "left")
    found = found.select("ord", F.coalesce(F.expr("nullif(file_id, '')"), F.col("_by_path")).alias("file_id"))
    known = found.where("file_id IS NOT NULL").groupBy("file_id").agg(F.min("ord").alias("ord")).select("ord", "file_id")
    return known.unionByName(found.where("file_id IS NULL"))


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """Upserts: the last row of each key."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("_r")).select(key, "_r.*")


# intake --------------------------------------------------------------------------------------


def within_budget(files: DataFrame, order: str, size: str, max_files: int, max_bytes: int) -> DataFrame:
    """Files in order up to the first that would pass a limit; later smaller ones are not tried.

    The running sum is by blocks of the order column: within a block by a window, over blocks by
    their totals, so no task holds more than a block and one row a block.
    """
    block = F.shiftright(F.col(order).cast("bigint"), 12)
    f = files.withColumn("_block", block)
    totals = f.groupBy("_block").agg(F.sum(size).alias("_s"), F.count(F.lit(1)).alias("_n"))
    run = Window.partitionBy(F.lit(0)).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_block", F.coalesce(F.sum("_s").over(run), F.lit(0)).alias("_s0"), F.coalesce(F.sum("_n").over(run), F.lit(0)).alias("_n0"))
    inside = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    f = f.join(before, "_block").withColumn("running_bytes", F.col("_s0") + F.sum(size).over(inside)).withColumn("running_files", F.col("_n0") + F.count(F.lit(1)).over(inside))
    # sizes are not negative, so both sums only grow
    return f.where((F.col("running_bytes") <= max_bytes) & (F.col("running_files") <= max_files)).drop("_block", "_s0", "_n0")


def extractor_plan(files: DataFrame, routes: list[tuple[list[str], str]], overrides: dict[str, str] | None = None, default: str = "tika") -> DataFrame:
    """suffix, extractor, files and the first three names of each pair; an override beats the routes."""
    kind = paths.suffix(F.col("source_relpath"))
    routed = paths.first_route(kind, routes, default)
    if overrides:
        routed = F.coalesce(F.create_map(*[x for k, v in overrides.items() for x in (F.lit(k.lower()), F.lit(v))])[kind], routed)
    names = F.slice(F.array_sort(F.collect_list(F.struct("ord", F.col("name")))), 1, 3)
    rows = files.select(kind.alias("suffix"), routed.alias("extractor"), "ord", paths.basename(F.col("source_relpath")).alias("name"))
    # three first names of each pair: cut before they meet
    place = F.row_number().over(Window.partitionBy("suffix", "extractor").orderBy("ord"))
    first = rows.withColumn("_k", place).where("_k <= 3").groupBy("suffix", "extractor").agg(F.array_join(F.transform(names, lambda x: x["name"]), ",").alias("examples"))
    return rows.groupBy("suffix", "extractor").agg(F.count(F.lit(1)).alias("files")).join(first, ["suffix", "extractor"])


def reconcile(catalog: DataFrame, source: DataFrame) -> DataFrame:
    """source_relpath, file_id, state, moved_to, new_file_id: unchanged, changed, moved, missing or new.

    Both hold source_relpath and file_id; paths are unique. Same path: unchanged, or changed with the
    content it has now. A catalog path that is gone has moved if its content is anywhere in the source (at
    the last of its paths in order), else it is missing. Source paths that the catalog doesn't have are
    new unless something moved has their content.
    """
    none = F.lit(None).cast("string")
    c = catalog.select("source_relpath", "file_id")
    s = source.select("source_relpath", F.col("file_id").alias("_now"))
    found = c.join(s, "source_relpath", "left")
    same = F.col("file_id") == F.col("_now")
    here = found.where("_now IS NOT NULL").select("source_relpath", "file_id", F.when(same, "unchanged").otherwise("changed").alias("state"), none.alias("moved_to"), F.when(~same, F.col("_now")).alias("new_file_id"))
    places = s.groupBy(F.col("_now").alias("file_id")).agg(F.max("source_relpath").alias("moved_to"))
    gone = found.where("_now IS NULL").join(places, "file_id", "left").select("source_relpath", "file_id", F.when(F.col("moved_to").isNotNull(), "moved").otherwise("missing").alias("state"), "moved_to", none.alias("new_file_id"))
    fresh = s.join(c, "source_relpath", "left_anti").select("source_relpath", F.col("_now").alias("file_id"))
    new = fresh.join(gone.where("state = 'moved'").select("file_id").distinct(), "file_id", "left_anti")
    return here.unionByName(gone).unionByName(new.select("source_relpath", "file_id", F.lit("new").alias("state"), none.alias("moved_to"), none.alias("new_file_id")))


def reconciled_states(changes: DataFrame) -> DataFrame:
    """file_id, status, source_relpath: the source states that a reconciliation writes, one row a content id.

    Where content is in several rows, an active one wins, then the least path.
    """
    rows = changes.select(F.coalesce("new_file_id", "file_id").alias("file_id"), F.when(F.col("state") == "missing", "missing_source").otherwise("active").alias("status"), F.coalesce("moved_to", "source_relpath").alias("source_relpath"))
    return first_seen(rows, ["file_id"], ["status", "source_relpath"])


def apply_reconciliation(objects: DataFrame, changes: DataFrame) -> DataFrame:
    """file_id, source_relpath, work: the objects of a catalog after a reconciliation.

    Moved objects have their new path, changed and new files are to be extracted (work 'extract'), what
    is missing stays as it is; one row for each row of changes.
    """
    rows = changes.select(F.coalesce("new_file_id", "file_id").alias("file_id"), F.coalesce("moved_to", "source_relpath").alias("source_relpath"), F.when(F.col("state").isin("changed", "new"), "extract").otherwise("keep").alias("work"))
    known = objects.select("file_id").distinct().withColumn("_known", F.lit(True))
    return rows.join(known, "file_id", "left").select("file_id", "source_relpath", F.when(F.col("_known").isNull(), F.lit("extract")).otherwise(F.col("work")).alias("work"))
