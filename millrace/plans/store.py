"""The written corpus: objects, provenance, segments, edits, syntheses and enrichments as snapshot tables.

Every table changes scope by scope in one commit, so a reader of one table never meets half a change. The
rows name the file that a store of folders would keep them in, so that listings and references agree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import snippet, strip
from millrace.operators import artifacts, enrich
from millrace.sources.snapshots import SnapshotTable

SCOPES = ("object", "folder", "collection", "root")
#: the columns that each table is changed and named by
TABLES: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "objects": (("file_id",), ("file_id",)),
    "provenance": (("file_id",), ("file_id",)),
    "segments": (("file_id",), ("file_id", "segment_id")),
    "edits": (("file_id",), ("file_id", "segment_id")),
    "stale": (("file_id",), ("file_id",)),
    "artifacts": (("scope_type", "scope_id"), ("scope_type", "scope_id", "kind", "base")),
    "root": (("name",), ("name",)),
}
#: the kind of artifacts that are syntheses; all others are enrichments
SYNTHESIS = "synthesis"


def artifact_base(kind: Column, method: Column) -> Column:
    """The name of a variant in its folder: the method, for an enrichment after its kind; null where a part is blank."""
    part = lambda c: F.when(strip(F.coalesce(c, F.lit(""))) != "", F.replace(strip(c), F.lit(" "), F.lit("_")))
    return F.when(kind == SYNTHESIS, part(method)).otherwise(F.concat(part(kind), F.lit("--"), part(method)))


def artifact_folder(scope_type: Column, scope_id: Column, kind: Column) -> Column:
    """The folder of a scope's syntheses or enrichments, relative to the store."""
    what = F.when(kind == SYNTHESIS, "syntheses").otherwise("enrichments")
    return (
        F.when(scope_type == "object", F.concat(F.lit("objects/"), scope_id, F.lit("/"), what))
        .when(scope_type == "folder", F.concat(F.lit("folders/folder-"), scope_id, F.lit("."), what))
        .when(scope_type == "collection", F.concat(F.lit("collections/"), scope_id, F.lit("/"), what))
        .when(scope_type == "root", what)
    )


def artifact_rows(new: DataFrame) -> DataFrame:
    """The rows to store of new artifacts (scope_type, scope_id, kind, method, payload, metadata, written), and their problem.

    problem is null where a row can be stored. The root has one id, whatever is given. Syntheses are texts
    beside a file of metadata, enrichments JSON beside one.
    """
    kind, scope_type = strip(F.coalesce("kind", F.lit(""))), F.lower(strip(F.coalesce("scope_type", F.lit(""))))
    rows = new.withColumn("kind", kind).withColumn("scope_type", scope_type)
    rows = rows.withColumn("scope_id", F.when(F.col("scope_type") == "root", "root").otherwise(strip(F.coalesce("scope_id", F.lit("")))))
    base, folder = artifact_base(F.col("kind"), F.col("method")), artifact_folder(F.col("scope_type"), F.col("scope_id"), F.col("kind"))
    problem = F.when(~F.col("scope_type").isin(*SCOPES), "unsupported scope type").when(F.col("scope_id") == "", "scope id is required").when(F.col("kind") == "", "kind is required").when(base.isNull(), "method is required")
    text = F.col("kind") == SYNTHESIS
    path = F.concat(folder, F.lit("/"), base)
    return rows.select(
        "scope_type", "scope_id", "kind", base.alias("base"), F.col("method"), "payload", F.coalesce("metadata", F.lit("{}")).alias("metadata"), "written",
        F.concat(path, F.when(text, ".txt").otherwise(".json")).alias("data_path"), F.concat(path, F.when(text, ".json").otherwise(".meta.json")).alias("metadata_path"), problem.alias("problem"),
    )


@dataclass(frozen=True)
class CorpusStore:
    """The tables of a corpus under one path."""

    spark: SparkSession
    path: str
    buckets: int = 16

    def table(self, name: str) -> SnapshotTable:
        if name not in TABLES:
            raise ValueError(f"the store has no table {name!r}")
        return SnapshotTable(self.spark, f"{self.path}/{name}", *TABLES[name], self.buckets)

    def read(self, name: str, schema: str, **how) -> DataFrame:
        """The rows of a table; an empty frame of schema before its first commit."""
        t = self.table(name)
        return t.read(**how) if t.version() else self.spark.createDataFrame([], schema)

    # objects -----------------------------------------------------------------------------------

    def write_objects(self, objects: DataFrame) -> int:
        """Write what is known of files (file_id and any columns); a file that was written before is replaced."""
        return self.table("objects").put(objects)

    def write_provenance(self, rows: DataFrame) -> int:
        """Write file_id, status, extractor and whatever else is known of how objects were made, in place of what was."""
        return self.table("provenance").put(rows)

    def note_synthesis(self, rows: DataFrame) -> int:
        """Add to the provenance of files who synthesized them (file_id and any columns); the rest of it stays."""
        return self.table("provenance").update(rows)

    def write_segments(self, segments: DataFrame) -> int:
        """Write the segments of files (file_id, segment_id, ord, text...) in place of all segments that those files had."""
        return self.table("segments").replace(segments)

    # edits -------------------------------------------------------------------------------------

    def put_edits(self, edits: DataFrame) -> int:
        """Write edited segments (file_id, segment_id, text) in place of all edits of these files, and mark what is stale.

        An edit of an unknown segment, without an id or without a text is an error, and nothing is written.
        """
        given = edits.select("file_id", strip(F.coalesce("segment_id", F.lit(""))).alias("segment_id"), "text")
        wrong = artifacts.edit_problems(given.withColumnRenamed("text", "new_text"), self.table("segments").read(scopes=given), "file_id").first()
        if wrong:
            raise ValueError(f"{wrong['problem']}: {wrong['segment_id']!r} of {wrong['file_id']}")
        self._mark(given)
        return self.table("edits").replace(given)

    def delete_edits(self, files: DataFrame) -> int:
        """Take the edits of files (file_id) away, and mark what is stale."""
        self._mark(files)
        return self.table("edits").delete(files.select("file_id"))

    def _mark(self, files: DataFrame) -> None:
        self.table("stale").put(files.select("file_id").distinct().select("file_id", F.lit(True).alias("embeddings"), F.lit(True).alias("search_chunks")))

    def stale(self) -> DataFrame:
        """file_id, embeddings, search_chunks of the files whose artifacts are older than their text."""
        return self.read("stale", "file_id string, embeddings boolean, search_chunks boolean")

    def rebuilt(self, files: DataFrame) -> int:
        """Say that the artifacts of files (file_id) are up to date again."""
        return self.table("stale").delete(files.select("file_id"))

    def preferred(self, files: DataFrame | None = None) -> DataFrame:
        """file_id, representation, kind, text: the edited text of files that have one, else that of their segments.

        files (file_id): only these, and only their buckets are read.
        """
        how = {} if files is None else {"scopes": files}
        segments = self.read("segments", "file_id string, segment_id string, ord bigint, text string", **how)
        edits = self.read("edits", "file_id string, segment_id string, text string", **how)
        segments = segments.select("file_id", "segment_id", "ord", "text")
        edits = edits.select("file_id", "segment_id", F.col("text").alias("new_text"))
        touched = edits.select("file_id").distinct().withColumn("_edited", F.lit(True))
        texts = enrich.edited_texts(segments, edits).join(touched, "file_id", "left")
        was = F.col("_edited").isNotNull()
        return texts.select("file_id", F.when(was, "edited").otherwise("canonical").alias("representation"), F.when(was, "edited_text").otherwise("canonical_extracted_text").alias("kind"), "text")

    # artifacts ---------------------------------------------------------------------------------

    def put_artifacts(self, new: DataFrame) -> int:
        """Write syntheses and enrichments (see artifact_rows); a variant of the same name is replaced, the latest of several holds.

        A row with a problem is an error, and nothing is written.
        """
        rows = artifact_rows(new)
        wrong = rows.where("problem IS NOT NULL").first()
        if wrong:
            raise ValueError(f"{wrong['problem']}: {wrong['scope_type']} {wrong['scope_id']!r}")
        return self.table("artifacts").put(rows.drop("problem"), order="written")

    def delete_artifacts(self, names: DataFrame) -> int:
        """Delete the artifacts of scopes (scope_type, scope_id), or single ones (with kind and base)."""
        return self.table("artifacts").delete(names)

    def artifacts(self, scopes: DataFrame | None = None, version: int | None = None) -> DataFrame:
        """All artifacts, or those of scopes (scope_type, scope_id), as of a version."""
        kind = "scope_type string, scope_id string, kind string, base string, method string, payload string, metadata string, written timestamp, data_path string, metadata_path string"
        return self.read("artifacts", kind, scopes=scopes, version=version)

    def current(self, kind: str = SYNTHESIS, scopes: DataFrame | None = None) -> DataFrame:
        """scope_type, scope_id, method, payload: of each scope the artifact of a kind that was written last."""
        return artifacts.current(self.artifacts(scopes), kind)

    def listing(self, scopes: DataFrame | None = None) -> DataFrame:
        """scope_type, scope_id, part (syntheses or enrichments), name, relpath: the files of artifacts, two each."""
        files = F.explode(F.array("data_path", "metadata_path"))
        part = F.when(F.col("kind") == SYNTHESIS, "syntheses").otherwise("enrichments")
        return self.artifacts(scopes).select("scope_type", "scope_id", part.alias("part"), files.alias("relpath")).select("scope_type", "scope_id", "part", F.element_at(F.split("relpath", "/"), -1).alias("name"), "relpath")

    def scope_summaries(self, members: DataFrame) -> DataFrame:
        """What each scope (scope_type, scope_id, file_id of its members; null: it has none) has.

        member_count, has_synthesis, synthesis_preview, n_syntheses, has_enrichments, n_enrichments,
        can_synthesize, can_enrich. The preview of a collection is the name of its first file of syntheses, that
        of other scopes the beginning of their current synthesis; files are counted, two for a variant.
        """
        keys = ["scope_type", "scope_id"]
        n = members.groupBy(*keys).agg(F.count("file_id").alias("member_count"))
        made = self.artifacts(n.select(*keys))
        text = F.col("kind") == SYNTHESIS
        first = F.min(F.when(text, F.struct(F.lower("metadata_path").alias("l"), F.col("metadata_path").alias("p"))))
        latest = F.max_by(F.when(text, F.col("payload")), F.when(text, F.struct("written", "method")))
        has = made.groupBy(*keys).agg(F.count(F.when(text, 1)).alias("s"), F.count(F.when(~text, 1)).alias("e"), first.alias("first"), latest.alias("latest"))
        out = n.join(has, keys, "left")
        some = F.col("member_count") > 0
        preview = F.when(F.col("scope_type") == "collection", F.element_at(F.split("first.p", "/"), -1)).otherwise(snippet(F.col("latest"), 240))
        s, e = F.coalesce("s", F.lit(0)), F.coalesce("e", F.lit(0))
        return out.select(*keys, "member_count", (s > 0).alias("has_synthesis"), preview.alias("synthesis_preview"), (2 * s).alias("n_syntheses"), (e > 0).alias("has_enrichments"), (2 * e).alias("n_enrichments"), some.alias("can_synthesize"), some.alias("can_enrich"))

    # the store as a whole ----------------------------------------------------------------------

    def describe(self, rows: DataFrame) -> int:
        """Write small records of the store (name, payload): its descriptor, metadata of runs, manifests of intakes."""
        return self.table("root").put(rows)
