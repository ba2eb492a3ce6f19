"""Queries over records of objects and what users configure, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalogue import COLL, _docs, _objects, _t, query
from millrace.functions import paths
from millrace.operators import records
from millrace.operators.scopes import Scope
from millrace.sources import corpus


def _records(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    o = _objects(spark, sf_dir).groupBy("file_id").agg(F.min("source_relpath").alias("source_relpath"), F.min("doc_id").alias("d"), F.min_by("text", "doc_id").alias("text"))
    d = F.col("d")
    meta = o.select("file_id", "source_relpath", F.when(d % 9 != 0, paths.basename(F.col("source_relpath"))).alias("filename"), F.when(d % 2 == 0, "application/pdf").when(d % 5 != 0, "text/plain").alias("mime"))
    provenance = o.where("d % 4 <> 3").select("file_id", F.when(d % 4 == 0, "plain").when(d % 4 == 1, "layout").otherwise("gone").alias("extractor_name"), F.when(d % 6 == 0, "firstN").alias("synthesizer_name"))
    manifest = o.where("d % 3 <> 0").select("file_id", F.explode(F.sequence(F.lit(1), (d % 3 + 1).cast("int"))).alias("i")).select("file_id", F.when(F.col("i") == 2, "image").otherwise("text").alias("kind"))
    preferred = o.where("d % 3 <> 0").select("file_id", F.when(d % 10 == 1, "edited_text").otherwise("canonical_extracted_text").alias("kind"))
    made = o.where("d % 5 = 0").select(F.lit("object").alias("scope_type"), F.col("file_id").alias("scope_id"), F.lit("synthesis").alias("kind"), F.lit("m").alias("method"), F.col("text").alias("payload"), F.lit(1).alias("written"))
    more = o.where("d % 7 = 0").select(F.lit("object").alias("scope_type"), F.col("file_id").alias("scope_id"), F.lit("table").alias("kind"), F.lit("m").alias("method"), F.lit("{}").alias("payload"), F.lit(1).alias("written"))
    states = o.where("d % 11 = 0").select("file_id", F.lit("missing_source").alias("status"))
    members = corpus.collections(docs, _t(spark, sf_dir, "labels"))[1].withColumn("kind", F.lit(None).cast("string"))
    named = lambda *rows: spark.createDataFrame(rows, "id string, display_name string")
    return o, members, records.object_records(meta, provenance, manifest, preferred, made.unionByName(more), members, states, named(("plain", "Plain text"), ("layout", "Layout")), named(("firstN", "First N")), markdown=("layout",))


RECORDS = rf"""{COLL}, o AS (SELECT file_id, min(source_relpath) AS source_relpath, min(doc_id) AS d, arg_min(text, doc_id) AS text FROM objects GROUP BY 1),
c AS (SELECT file_id, string_agg(name, ',' ORDER BY lower(name)) AS collections FROM (SELECT DISTINCT file_id, name FROM members) GROUP BY 1),
rec AS (SELECT file_id, CASE WHEN d % 9 <> 0 THEN string_split(source_relpath, '/')[-1] END AS filename, source_relpath, CASE WHEN d % 2 = 0 THEN 'application/pdf' WHEN d % 5 <> 0 THEN 'text/plain' END AS mime, CASE WHEN d % 9 <> 0 THEN string_split(source_relpath, '/')[-1] ELSE file_id END AS title, source_relpath AS subtitle,
 CASE d % 4 WHEN 0 THEN 'plain' WHEN 1 THEN 'layout' WHEN 2 THEN 'gone' END AS extractor_name, CASE d % 4 WHEN 0 THEN 'Plain text' WHEN 1 THEN 'Layout' END AS extractor_display, CASE WHEN d % 4 <> 3 AND d % 6 = 0 THEN 'firstN' END AS synthesizer_name, CASE WHEN d % 4 <> 3 AND d % 6 = 0 THEN 'First N' END AS synthesizer_display,
 CASE WHEN d % 3 = 0 THEN 0 ELSE d % 3 + 1 END AS manifest_record_count, CASE d % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS text_count, CASE WHEN d % 3 = 0 THEN 0 ELSE 1 END AS image_count, d % 3 <> 0 AS has_preferred_text, CASE WHEN d % 3 = 0 THEN NULL WHEN d % 10 = 1 THEN 'edited_text' ELSE 'canonical_extracted_text' END AS preferred_text_kind, d % 3 <> 0 AND d % 10 = 1 AS has_editable_text,
 d % 5 = 0 AS has_synthesis, CASE WHEN d % 5 = 0 AND length(text) > 0 THEN trim(left(text, 240), E' \t\n\r\x0b\x0c') END AS synthesis_preview, d % 7 = 0 AS has_enrichments, coalesce(collections, '') AS collections, d % 2 = 0 AS preview_available, d % 4 = 1 AS supports_markdown_render, true AS can_extract, d % 3 <> 0 AS can_synthesize, d % 3 <> 0 AS can_enrich, d % 11 <> 0 AS source_is_active FROM o LEFT JOIN c USING (file_id))"""


def _flat(found):
    return found.withColumn("collections", F.array_join(F.transform("collections", lambda c: c["name"]), ","))


@query(f"WITH {RECORDS} SELECT * FROM rec")
def object_records(spark, sf_dir):
    return _flat(_records(spark, sf_dir)[2])


@query(f"WITH {RECORDS} SELECT * FROM rec WHERE file_id IN (SELECT file_id FROM members WHERE name = 'toxic')")
def records_of_scope(spark, sf_dir):
    o, members, found = _records(spark, sf_dir)
    return _flat(records.scope_records(found, o, Scope("collection", "toxic"), members.withColumn("collection_id", F.col("name")))).drop("ord")


@query("""WITH e AS (SELECT doc_id AS place, CASE WHEN doc_id % 10 <> 0 THEN 'x' || doc_id // 2 END AS id, CASE WHEN doc_id % 3 <> 0 THEN 'name' END AS name, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'ftp' ELSE 'http' END AS type, CASE WHEN doc_id % 5 = 0 THEN 'oauth' ELSE 'none' END AS auth, CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS enabled, CASE WHEN doc_id % 2 = 0 THEN 'http://h' END AS url FROM documents),
f AS (SELECT *, min(place) OVER (PARTITION BY id) AS first FROM e)
SELECT place, 'error' AS level, 'extractor ' || place || ' missing ''id''.' AS problem FROM e WHERE id IS NULL UNION ALL SELECT place, 'error', 'Duplicate extractor id: ''' || id || '''.' FROM f WHERE id IS NOT NULL AND place > first UNION ALL SELECT place, 'error', 'extractor ' || place || ' missing ''display_name''.' FROM e WHERE name IS NULL
UNION ALL SELECT place, 'error', 'extractor ''' || coalesce(id, place::VARCHAR) || ''' has invalid type ''' || coalesce(type, 'None') || '''. Allowed: [''http'']' FROM e WHERE type IS NULL OR type <> 'http' UNION ALL SELECT place, 'error', 'extractor ''' || coalesce(id, place::VARCHAR) || ''' has invalid auth_type ''oauth''. Allowed: [''api_key'', ''none'']' FROM e WHERE auth = 'oauth'
UNION ALL SELECT place, 'error', 'extractor ''' || coalesce(id, place::VARCHAR) || ''' must have boolean ''enabled''.' FROM e WHERE enabled IS NULL UNION ALL SELECT place, 'warning', 'extractor ''' || coalesce(id, 'None') || ''' is enabled but has no base_url configured.' FROM e WHERE type = 'http' AND enabled AND url IS NULL""")
def extractor_registry(spark, sf_dir):
    k = F.col("doc_id")
    entries = _docs(spark, sf_dir).select(
        k.alias("place"), F.when(k % 10 != 0, F.concat(F.lit("x"), F.floor(k / 2).cast("string"))).alias("id"), F.when(k % 3 != 0, "name").otherwise("").alias("display_name"), F.when(k % 4 == 1, "ftp").when(k % 4 > 1, "http").alias("type"),
        F.when(k % 5 == 0, "oauth").otherwise("none").alias("auth_type"), F.when(k % 7 == 1, False).when(k % 7 > 1, True).alias("enabled"), F.when(k % 2 == 0, "http://h").alias("base_url"))
    return records.extractor_problems(entries)


@query("""SELECT 'e-' || doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'e-' || doc_id ELSE 'Shown' END AS display_name, CASE WHEN doc_id % 3 = 0 THEN 'other' ELSE 'enricher' END AS kind, CASE WHEN doc_id % 5 = 0 THEN 'ftp://h' ELSE 'https://h/' || doc_id END AS base_url, doc_id % 4 <> 0 AS enabled,
 CASE WHEN doc_id % 7 = 0 THEN 'the id already exists' WHEN doc_id % 3 = 0 THEN 'unknown kind' WHEN doc_id % 5 = 0 THEN 'base_url must start with http:// or https://' END AS problem FROM documents""")
def endpoint_checks(spark, sf_dir):
    k = F.col("doc_id")
    id_ = F.concat(F.lit(" E-"), k.cast("string"))
    given = _docs(spark, sf_dir).select(id_.alias("id"), F.when(k % 2 == 1, " Shown ").alias("display_name"), F.when(k % 3 == 0, "Other").otherwise(" Enricher").alias("kind"), F.when(k % 5 == 0, "ftp://h//").otherwise(F.concat(F.lit(" https://h/"), k.cast("string"), F.lit("/"))).alias("base_url"), F.when(k % 4 == 0, False).alias("enabled"))
    return records.endpoints(given, _docs(spark, sf_dir).where("doc_id % 7 = 0").select(F.concat(F.lit("e-"), k.cast("string")).alias("id")))


@query(r"""WITH l AS (SELECT doc_id, left(text, 60) AS a, substr(text, 61, 20) || ' = ' || doc_id || '=x ' AS b FROM documents), p AS (SELECT doc_id, 0 AS i, a AS o FROM l UNION ALL SELECT doc_id, 1, b FROM l UNION ALL SELECT doc_id, 2, ' =v' FROM l)
SELECT doc_id, i, CASE WHEN ok THEN k END AS key, CASE WHEN ok THEN trim(substr(o, strpos(o, '=') + 1), E' \t\n\r\x0b\x0c') END AS value, CASE WHEN NOT contains(o, '=') THEN 'expected key=value' WHEN k = '' THEN 'empty key' END AS problem
FROM (SELECT *, trim(CASE WHEN contains(o, '=') THEN left(o, strpos(o, '=') - 1) ELSE o END, E' \t\n\r\x0b\x0c') AS k, contains(o, '=') AND trim(CASE WHEN contains(o, '=') THEN left(o, strpos(o, '=') - 1) ELSE o END, E' \t\n\r\x0b\x0c') <> '' AS ok FROM p)""")
def option_values(spark, sf_dir):
    options = F.array(F.left("text", F.lit(60)), F.concat(F.substring("text", 61, 20), F.lit(" = "), F.col("doc_id").cast("string"), F.lit("=x ")), F.lit(" =v"))
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(records.option_pairs(options)).alias("i", "o")).select("doc_id", "i", "o.key", "o.value", "o.problem")


@query("""WITH d AS (SELECT doc_id, source || '/' || lang || '/' || doc_id AS p FROM documents) SELECT 'doc-' || doc_id AS file_id, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 'shared/' || p WHEN doc_id % 3 = 1 THEN 'upload/' || p END AS path FROM d""")
def source_paths(spark, sf_dir):
    k, p = F.col("doc_id"), F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    d = _docs(spark, sf_dir)
    typed = F.when(k % 5 == 0, "").when(k % 2 == 0, F.replace(p, F.lit("/"), F.lit("\\"))).when(k % 3 == 0, F.concat(F.lit("/shared/"), p)).otherwise(F.concat(p, F.lit("/")))
    files = d.where("doc_id % 3 = 0").select(F.lit("shared").alias("root"), p.alias("relpath")).unionByName(d.where("doc_id % 3 < 2").select(F.lit("upload").alias("root"), p.alias("relpath")))
    return records.source_files(d.select(F.concat(F.lit("doc-"), k.cast("string")).alias("file_id"), typed.alias("source_relpath")), files)


@query("SELECT doc_id, 'data:' || CASE WHEN doc_id % 2 = 0 THEN 'text/plain' ELSE 'application/octet-stream' END || ';base64,' || to_base64(encode(text)) AS url FROM documents")
def data_urls(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", records.data_url(F.encode("text", "UTF-8"), F.when(F.col("doc_id") % 2 == 0, "text/plain")).alias("url"))
