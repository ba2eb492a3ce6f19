"""One record for each object with all that is known of it, and small checks of what users configure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import snippet, strip
from millrace.operators import artifacts as artifacts_
from millrace.operators.scopes import Scope, scope_members

#: fixed values: kinds of endpoints, and what an extractor's entry may say
ENDPOINT_KINDS = ("extractor", "synthesizer", "embedder", "enricher")
AUTH_TYPES, EXTRACTOR_TYPES = ("none", "api_key"), ("http",)


def kind_counts(manifest: DataFrame) -> DataFrame:
    """file_id, manifest_record_count, text_count, image_count of the records of manifests (file_id, kind)."""
    return manifest.groupBy("file_id").agg(F.count(F.lit(1)).alias("manifest_record_count"), F.count(F.when(F.col("kind") == "text", 1)).alias("text_count"), F.count(F.when(F.col("kind") == "image", 1)).alias("image_count"))


def named(rows: DataFrame, column: str, registry: DataFrame, into: str) -> DataFrame:
    """The rows with the display name that a registry (id, display_name) has for a column; null where it has none."""
    return rows.join(registry.select(F.col("id").alias("_id"), F.col("display_name").alias(into)), F.col(column) == F.col("_id"), "left").drop("_id")


def object_records(meta: DataFrame, provenance: DataFrame, manifest: DataFrame, preferred: DataFrame, artifacts: DataFrame, members: DataFrame, states: DataFrame, extractors: DataFrame, synthesizers: DataFrame, markdown: tuple[str, ...] = ()) -> DataFrame:
    """One row for each object of meta (file_id, source_relpath, filename, mime): what it is, how it was made, what it has, where it belongs.

    provenance: file_id, extractor_name, synthesizer_name. manifest: file_id, kind. preferred: file_id, kind. artifacts: those of
    the store. members: file_id, collection_id, name, kind. states: file_id, status (without one an object is active).
    Registries: id, display_name. markdown names the extractors whose text is Markdown. A star of left joins on file_id; collections are an array, by name.
    """
    own = artifacts.where("scope_type = 'object'")
    made = artifacts_.current(own).select(F.col("scope_id").alias("file_id"), F.col("payload").alias("_synthesis"))
    more = own.where("kind <> 'synthesis'").select(F.col("scope_id").alias("file_id")).distinct().withColumn("_more", F.lit(True))
    colls = members.groupBy("file_id").agg(F.collect_set(F.struct(F.lower("name").alias("l"), F.col("name"), F.col("collection_id").alias("id"), F.col("kind"))).alias("_c"))
    made_by = named(named(provenance.select("file_id", "extractor_name", "synthesizer_name"), "extractor_name", extractors, "extractor_display"), "synthesizer_name", synthesizers, "synthesizer_display")
    rows = meta.select("file_id", "source_relpath", "filename", "mime")
    for other in (made_by, kind_counts(manifest), preferred.select("file_id", F.col("kind").alias("preferred_text_kind")), made, more, colls, states.select("file_id", "status")):
        rows = rows.join(other, "file_id", "left")
    n = F.coalesce("manifest_record_count", F.lit(0))
    edited = F.coalesce(F.col("preferred_text_kind") == "edited_text", F.lit(False))
    return rows.select(
        "file_id", "filename", "source_relpath", "mime", F.coalesce("filename", "file_id").alias("title"), F.coalesce("source_relpath", F.lit("")).alias("subtitle"),
        "extractor_name", "extractor_display", "synthesizer_name", "synthesizer_display",
        n.alias("manifest_record_count"), F.coalesce("text_count", F.lit(0)).alias("text_count"), F.coalesce("image_count", F.lit(0)).alias("image_count"),
        F.col("preferred_text_kind").isNotNull().alias("has_preferred_text"), "preferred_text_kind", edited.alias("has_editable_text"),
        F.col("_synthesis").isNotNull().alias("has_synthesis"), snippet(F.col("_synthesis"), 240).alias("synthesis_preview"), F.coalesce("_more", F.lit(False)).alias("has_enrichments"),
        F.coalesce(F.transform(F.array_sort("_c"), lambda c: F.struct(c["id"].alias("id"), c["name"].alias("name"), c["kind"].alias("kind"))), F.array()).alias("collections"),
        F.coalesce(F.col("mime") == "application/pdf", F.lit(False)).alias("preview_available"), F.coalesce(F.col("extractor_name").isin(*markdown), F.lit(False)).alias("supports_markdown_render"),
        F.lit(True).alias("can_extract"), (n > 0).alias("can_synthesize"), (n > 0).alias("can_enrich"), (F.coalesce("status", F.lit("active")) == "active").alias("source_is_active"),
    )


def scope_records(records: DataFrame, objects: DataFrame, scope: Scope, members: DataFrame | None = None, folders: DataFrame | None = None) -> DataFrame:
    """The records of a scope's members, with their order in it; members that no record is known of are left out."""
    return records.join(scope_members(objects, scope, members, folders), "file_id")


# what users configure ----------------------------------------------------------------------------


def extractor_problems(entries: DataFrame) -> DataFrame:
    """place, level (error or warning), problem of the entries of a registry (place from 1, id, display_name, type, auth_type, enabled, base_url)."""
    some = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    first = entries.where(some("id")).groupBy("id").agg(F.min("place").alias("_first"))
    e = entries.join(first, "id", "left")
    who = F.when(some("id"), F.col("id")).otherwise(F.col("place").cast("string"))
    said = lambda c: F.coalesce(F.col(c), F.lit("None"))
    error = lambda when, text: F.when(when, F.struct(F.lit("error").alias("level"), text.alias("problem")))
    none = lambda c, allowed: ~F.coalesce(F.col(c).isin(*allowed), F.lit(False))
    found = F.array(
        error(~some("id"), F.concat(F.lit("extractor "), F.col("place").cast("string"), F.lit(" missing 'id'."))),
        error(some("id") & (F.col("place") > F.col("_first")), F.concat(F.lit("Duplicate extractor id: '"), F.col("id"), F.lit("'."))),
        error(~some("display_name"), F.concat(F.lit("extractor "), F.col("place").cast("string"), F.lit(" missing 'display_name'."))),
        error(none("type", EXTRACTOR_TYPES), F.concat(F.lit("extractor '"), who, F.lit("' has invalid type '"), said("type"), F.lit("'. Allowed: ['http']"))),
        error(none("auth_type", AUTH_TYPES), F.concat(F.lit("extractor '"), who, F.lit("' has invalid auth_type '"), said("auth_type"), F.lit("'. Allowed: ['api_key', 'none']"))),
        error(F.col("enabled").isNull(), F.concat(F.lit("extractor '"), who, F.lit("' must have boolean 'enabled'."))),
        F.when((F.col("type") == "http") & F.col("enabled") & ~some("base_url"), F.struct(F.lit("warning").alias("level"), F.concat(F.lit("extractor '"), said("id"), F.lit("' is enabled but has no base_url configured.")).alias("problem"))),
    )
    return e.select("place", F.explode(F.array_compact(found)).alias("f")).select("place", "f.level", "f.problem")


def endpoints(given: DataFrame, known: DataFrame) -> DataFrame:
    """The endpoints as they are kept (id, display_name, kind, base_url, enabled) and the problem of those that aren't.

    given holds id, display_name, kind, base_url and enabled as typed; known holds the ids there are. An endpoint
    without an id gets one made of what it says, the same each time.
    """
    clean = lambda c: strip(F.coalesce(F.col(c), F.lit("")))
    made = F.concat(F.lit("endpoint-"), F.left(F.sha2(F.concat_ws("|", "kind", "base_url", "display_name"), 256), F.lit(8)))
    id_ = F.when(clean("id") == "", made).otherwise(F.lower(clean("id")))
    rows = given.select(id_.alias("id"), clean("display_name").alias("_d"), F.lower(clean("kind")).alias("kind"), F.regexp_replace(clean("base_url"), "/+$", "").alias("base_url"), F.coalesce("enabled", F.lit(True)).alias("enabled"))
    rows = rows.join(known.select("id").distinct().withColumn("_known", F.lit(True)), "id", "left")
    problem = F.when(~F.col("id").rlike(r"\A[a-z0-9][a-z0-9_.-]*\z"), "id must contain lowercase letters, numbers, dots, underscores, or hyphens").when(F.col("_known"), "the id already exists")
    problem = problem.when(~F.col("kind").isin(*ENDPOINT_KINDS), "unknown kind").when(~F.col("base_url").rlike(r"\Ahttps?://"), "base_url must start with http:// or https://")
    return rows.select("id", F.when(F.col("_d") == "", F.col("id")).otherwise(F.col("_d")).alias("display_name"), "kind", "base_url", "enabled", problem.alias("problem"))


def option_pairs(options: Column) -> Column:
    """key, value and problem of options typed as key=value, in an array: blanks around both don't count, the value may have more signs."""
    def one(o: Column) -> Column:
        key = strip(F.substring_index(o, "=", 1))
        value = strip(F.substring(o, F.locate("=", o) + 1, F.length(o)))
        problem = F.when(o.isNull() | ~F.contains(o, F.lit("=")), "expected key=value").when(key == "", "empty key")
        return F.struct(F.when(problem.isNull(), key).alias("key"), F.when(problem.isNull(), value).alias("value"), problem.alias("problem"))

    return F.transform(options, one)


def data_url(content: Column, mime: Column) -> Column:
    """Bytes as a data URL, without the line ends that base64 has elsewhere; without a type they are a stream of octets."""
    return F.concat(F.lit("data:"), F.coalesce(mime, F.lit("application/octet-stream")), F.lit(";base64,"), F.translate(F.base64(content), "\r\n", ""))


def source_files(objects: DataFrame, files: DataFrame, roots: tuple[str, ...] = ("shared", "upload")) -> DataFrame:
    """file_id, path: where the source of each object (file_id, source_relpath) lies, in the first root that has it; null where none has.

    files holds root and relpath of the files there are. A path may begin with the name of its root, or not;
    back slashes and slashes around it don't count.
    """
    rel = F.btrim(F.replace(F.coalesce("source_relpath", F.lit("")), F.lit("\\"), F.lit("/")), F.lit("/"))
    asked = objects.select("file_id", rel.alias("_rel")).where("_rel <> ''")
    tries = []
    for i, root in enumerate(roots):
        tries += [F.when(F.col("_rel").startswith(f"{root}/"), F.struct(F.lit(2 * i).alias("n"), F.lit(root).alias("root"), F.substring("_rel", len(root) + 2, 1 << 20).alias("relpath"))), F.struct(F.lit(2 * i + 1).alias("n"), F.lit(root).alias("root"), F.col("_rel").alias("relpath"))]
    each = asked.select("file_id", F.explode(F.array_compact(F.array(*tries))).alias("t")).select("file_id", "t.*")
    there = each.join(files.select("root", "relpath").distinct(), ["root", "relpath"])
    best = there.groupBy("file_id").agg(F.min_by(F.concat_ws("/", "root", "relpath"), "n").alias("path"))
    return objects.select("file_id").distinct().join(best, "file_id", "left")
