"""Artifacts of scopes: syntheses and enrichments in variants, and what the corpus knows of objects and scopes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import paths
from millrace.functions.text import snippet, strip
from millrace.operators import enrich
from millrace.operators.catalog import latest

#: what names a variant
VARIANT = ("scope_type", "scope_id", "kind", "method")


def put_variants(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Variants (VARIANT, written, payload) after others were written: the last one of each name holds."""
    rows = existing.select(*VARIANT, "written", "payload").unionByName(new.select(*VARIANT, "written", "payload"))
    named = rows.withColumn("_name", F.struct(*VARIANT)).drop(*VARIANT)
    return latest(named, "_name", "written").select("_name.*", "written", "payload")


def current(variants: DataFrame, kind: str = "synthesis") -> DataFrame:
    """scope_type, scope_id, method, payload: the variant of a kind that was written last in each scope."""
    rows = variants.where(F.col("kind") == kind)
    best = rows.groupBy("scope_type", "scope_id").agg(F.max_by(F.struct("method", "payload"), F.struct("written", "method")).alias("v"))
    return best.select("scope_type", "scope_id", "v.*")


#: synthesizers of objects and of scopes: texts (doc_id, text) -> the same with their synthesis
SYNTHESIZERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "firstN": lambda texts: enrich.first_n(texts, 4000),
    "first_lines": lambda texts: texts.withColumn("text", F.concat(F.lit("## "), F.coalesce("filename", F.lit("")), F.lit("\n\n"), F.left("text", F.lit(500)))),
}


def synthesize(texts: DataFrame, name: str, more: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """doc_id, text: the syntheses that the named synthesizer writes; `more` adds synthesizers, such as those with a model.

    An unknown name is an error; blank syntheses are left out.
    """
    known = SYNTHESIZERS | (more or {})
    if name not in known:
        raise ValueError(f"unknown synthesizer {name!r}")
    made = known[name](texts)
    return made.select("doc_id", "text").where(strip(F.coalesce("text", F.lit(""))) != "")


#: enrichers of a scope: texts (doc_id, text) -> the rows of one artifact
ENRICHERS: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "stats_keywords": ("table", lambda texts: enrich.top_keywords(texts, 20)),
    "capitalized_entities": ("entity_list", enrich.capitalised_phrases),
    "table_rows": ("table", enrich.table_rows),
}


def run_enricher(texts: DataFrame, name: str, scope_type: str, scope_id: str, more: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] | None = None) -> DataFrame:
    """VARIANT and payload (JSON): the rows of an enricher as variants of a scope, a row each."""
    known = ENRICHERS | (more or {})
    if name not in known:
        raise ValueError(f"unknown enricher {name!r}")
    kind, run = known[name]
    rows = run(texts)
    return rows.select(F.lit(scope_type).alias("scope_type"), F.lit(scope_id).alias("scope_id"), F.lit(kind).alias("kind"), F.lit(name).alias("method"), F.to_json(F.struct(*rows.columns)).alias("payload"))


def scope_summaries(members: DataFrame, variants: DataFrame) -> DataFrame:
    """What each scope (scope_type, scope_id, file_id of its members) has: counts, flags, a preview and what can be done."""
    keys = ["scope_type", "scope_id"]
    n = members.groupBy(*keys).agg(F.count("file_id").alias("member_count"))
    made = current(variants).select(*keys, "payload")
    more = variants.where("kind <> 'synthesis'").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_enrichments"))
    out = n.join(made, keys, "left").join(more, keys, "left")
    some = F.col("member_count") > 0
    return out.select(
        *keys, "member_count", F.col("payload").isNotNull().alias("has_synthesis"), snippet(F.col("payload"), 240).alias("synthesis_preview"), F.col("n_enrichments").isNotNull().alias("has_enrichments"),
        F.coalesce("n_enrichments", F.lit(0)).alias("n_enrichments"), some.alias("can_synthesize"), some.alias("can_enrich"),
    )


def object_cards(objects: DataFrame, segments: DataFrame, preferred: DataFrame, variants: DataFrame, states: DataFrame, key: str = "doc_id") -> DataFrame:
    """All that is known of each object: extraction, texts, artifacts, source state and what can be done with it.

    preferred holds key and representation; variants those of objects (scope_id is the file id); states
    file_id and status. A star of left joins on keys.
    """
    n = segments.groupBy(key).agg(F.count(F.lit(1)).alias("manifest_record_count"))
    made = current(variants.where("scope_type = 'object'")).select(F.col("scope_id").alias("file_id"), "payload")
    more = variants.where("scope_type = 'object' AND kind <> 'synthesis'").select(F.col("scope_id").alias("file_id")).distinct().withColumn("_more", F.lit(True))
    out = objects.select(key, "file_id", "source_relpath").join(n, key, "left").join(preferred.select(key, "representation"), key, "left").join(made, "file_id", "left").join(more, "file_id", "left").join(states.select("file_id", "status"), "file_id", "left")
    count, mime = F.coalesce("manifest_record_count", F.lit(0)), paths.mime(F.col("source_relpath"))
    return out.select(
        key, "file_id", paths.basename(F.col("source_relpath")).alias("filename"), mime.alias("mime"), count.alias("manifest_record_count"), (count > 0).alias("has_extraction"), F.col("representation").isNotNull().alias("has_preferred_text"),
        F.col("representation").alias("preferred_text_kind"), F.col("payload").isNotNull().alias("has_synthesis"), snippet(F.col("payload"), 240).alias("synthesis_preview"), F.coalesce("_more", F.lit(False)).alias("has_enrichments"),
        (mime == "application/pdf").alias("preview_available"), F.lit(True).alias("can_extract"), (count > 0).alias("can_synthesize"), (count > 0).alias("can_enrich"), (F.coalesce("status", F.lit("active")) == "active").alias("source_is_active"),
    )


# edits ---------------------------------------------------------------------------------------


def edit_problems(edits: DataFrame, segments: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, segment_id, problem of edits (key, segment_id, new_text) that can't be kept."""
    known = segments.select(key, "segment_id").withColumn("_known", F.lit(True))
    sid = strip(F.coalesce("segment_id", F.lit("")))
    met = edits.withColumn("segment_id", sid).join(known, [key, "segment_id"], "left")
    problem = F.when(F.col("segment_id") == "", "segment id is required").when(F.col("_known").isNull(), "unknown segment id").when(F.col("new_text").isNull(), "text must be a string")
    return met.select(key, "segment_id", problem.alias("problem")).where("problem IS NOT NULL")


def stale(objects: DataFrame, edits: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, embeddings, search_chunks: what an edit has made out of date; false where nothing was edited."""
    touched = edits.select(key).distinct().withColumn("_e", F.lit(True))
    flag = F.coalesce("_e", F.lit(False))
    return objects.select(key).join(touched, key, "left").select(key, flag.alias("embeddings"), flag.alias("search_chunks"))


def without_edits(edits: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """The edits that are left when those of some objects are deleted."""
    return edits.join(gone.select(key).distinct(), key, "left_anti")
