"""Queries over artifacts, scopes, collections, checks and page regions, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalogue import COLL, FOLDERS, OBJ, SEG, WIN, _docs, _first, _objects, _reconciled, _t, _windows, query, RECON
from millrace.functions import paths, text
from millrace.operators import artifacts, catalog, checks, curation, embedding, enrich, overviews, regions, scopes
from millrace.sources import corpus

# paths and small expressions --------------------------------------------------------------------

ROOTED = "'/data/' || CASE doc_id % 3 WHEN 0 THEN 'shared/' WHEN 1 THEN 'upload/' ELSE 'other/' END || source || '/' || lang || '/doc-' || doc_id || '.v1.pdf'"


@query(f"""SELECT doc_id, p AS cleaned, CASE doc_id % 3 WHEN 0 THEN 'my_data/' || r WHEN 1 THEN 'uploaded_data/' || r ELSE b END AS shown, CASE WHEN doc_id % 3 = 0 THEN r ELSE b END AS under_root, substr(p, 1, length(p) - length(b)) || 'doc-' || doc_id || '.txt' AS artifact
FROM (SELECT doc_id, {ROOTED} AS p, source || '/' || lang || '/doc-' || doc_id || '.v1.pdf' AS r, 'doc-' || doc_id || '.v1.pdf' AS b FROM documents)""")
def user_paths(spark, sf_dir):
    root = F.when(F.col("doc_id") % 3 == 0, "shared/").when(F.col("doc_id") % 3 == 1, "upload/").otherwise("other/")
    typed = F.concat(F.lit(" \"'/data/"), root, F.col("source"), F.lit("/"), F.col("lang"), F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".v1.pdf'\" "))
    p = F.col("cleaned")
    d = _docs(spark, sf_dir).select("doc_id", paths.clean_user_path(typed).alias("cleaned"))
    return d.select("doc_id", "cleaned", paths.display_path(p, "/data/shared", "/data/upload").alias("shown"), paths.under_root("/data/shared", p).alias("under_root"), paths.artifact_path(p, ".txt").alias("artifact"))


@query("""SELECT doc_id, CASE lang WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'fra' WHEN 'de' THEN 'deu' WHEN 'es' THEN 'spa' ELSE 'eng' END AS reader, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE replace(source, ' ', '_') || '--of_' || lang END AS variant FROM documents""")
def reader_codes(spark, sf_dir):
    kind = F.when(F.col("doc_id") % 7 == 0, " ").otherwise(F.concat(F.lit(" "), F.col("source")))
    return _docs(spark, sf_dir).select("doc_id", paths.reader_language(F.upper("lang")).alias("reader"), paths.variant_name(kind, F.concat(F.lit("of "), F.col("lang"), F.lit(" "))).alias("variant"))


@query(rf"""WITH {SEG} SELECT doc_id, ord, CASE WHEN ord % 3 = 0 THEN d.text WHEN doc_id % 11 = 0 THEN NULL ELSE substr(d.text, (ord * 100 + 1)::BIGINT, 50) END AS text FROM seg JOIN documents d USING (doc_id)""")
def segment_slices(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    a = F.when(F.col("ord") % 3 == 0, None).when(F.col("doc_id") % 11 == 0, F.lit(-1)).otherwise(F.col("ord") * 100)
    s = enrich.segments(docs, key="doc_id").select("doc_id", "ord", a.alias("a"))
    return s.join(docs.select("doc_id", F.col("text").alias("whole")), "doc_id").select("doc_id", "ord", text.segment_slice(F.col("whole"), F.col("a"), F.col("a") + 50).alias("text"))


@query(r"""SELECT doc_id, CASE WHEN length(text) > 768 THEN 3 WHEN length(text) > 512 THEN 1 ELSE 0 END + CASE WHEN length(text) > 1024 THEN 0 WHEN length(text) > 768 THEN -1 ELSE 0 END AS n_tries, trim(text, E' \t\n\r\x0b\x0c') AS unfenced, list_filter(list_transform(string_split(text, E'\n'), lambda x: trim(x, E' \t\n\r\x0b\x0c')), lambda x: x <> '')[1] AS first_line FROM documents""")
def small_texts(spark, sf_dir):
    fenced = F.concat(F.lit("```text\n"), F.col("text"), F.lit("\n```"))
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", F.size(text.shorter_tries(t)).alias("n_tries"), text.strip(text.strip_fences(fenced)).alias("unfenced"), F.get(text.lines(t), F.lit(0)).alias("first_line"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'maximum context length' WHEN event_id % 4 = 1 THEN 'requested tokens embedding' ELSE 'timeout' END AS message, event_id % 4 < 2 AS too_long, CASE WHEN json_extract(props, '$') IS NULL THEN '' ELSE props END AS shown, CASE WHEN greatest(event_id % 9, 3) % 2 = 0 THEN greatest(event_id % 9, 3) + 1 ELSE greatest(event_id % 9, 3) END AS kernel FROM events""")
def message_classes(spark, sf_dir):
    k = F.col("event_id")
    m = F.when(k % 4 == 0, "maximum context length").when(k % 4 == 1, "requested tokens embedding").otherwise("timeout")
    return _t(spark, sf_dir, "events").select(k, m.alias("message"), text.too_long_error(F.initcap(m)).alias("too_long"), text.cell_text(F.col("props")).alias("shown"), checks.odd_kernel((k % 9).cast("bigint"), 3).alias("kernel"))


# lookups and listings ---------------------------------------------------------------------------


@query(f"WITH {OBJ} SELECT item_id, (SELECT file_id FROM objects WHERE doc_id = item_id AND item_id % 2 = 0) AS by_path, (SELECT count(*) FROM objects o WHERE o.source = 'src' || (item_id % 7)) AS beside FROM benchmark")
def point_lookups(spark, sf_dir):
    o = _objects(spark, sf_dir)
    b = _t(spark, sf_dir, "benchmark").select("item_id")
    known = o.select(F.col("doc_id").alias("item_id"), "source_relpath")
    typed = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit(" /"), F.replace("source_relpath", F.lit("/"), F.lit("\\"))))
    asked = b.join(known, "item_id", "left").select("item_id", typed.alias("p"), F.concat(F.lit("src"), (F.col("item_id") % 7).cast("string")).alias("top"))
    asked = catalog.found_by_path(asked, o, "p").withColumnRenamed("file_id", "by_path")
    n = o.groupBy(F.element_at(F.split("source_relpath", "/"), 1).alias("top")).agg(F.count(F.lit(1)).alias("beside"))
    return asked.join(n, "top", "left").select("item_id", "by_path", F.coalesce("beside", F.lit(0)).alias("beside"))


@query(f"""WITH {FOLDERS}, done AS (SELECT DISTINCT doc_id FROM labels), e AS (SELECT CASE WHEN contains(path, '/') THEN string_split(path, '/')[1] ELSE '' END AS path, 0 AS is_file, string_split(path, '/')[-1] AS name, NULL::BOOLEAN AS processed FROM allp WHERE path <> ''
UNION ALL SELECT source || '/' || lang, 1, 'doc-' || o.doc_id || '.txt', done.doc_id IS NOT NULL FROM objects o LEFT JOIN done ON done.doc_id = o.doc_id)
SELECT path, is_file, name, processed, row_number() OVER (PARTITION BY path ORDER BY is_file, lower(name), name) AS rank FROM e WHERE contains(lower(name), 'c-1') OR is_file = 0""")
def folder_listing(spark, sf_dir):
    o = _objects(spark, sf_dir)
    done = _t(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("processed", F.lit(True))
    rows = catalog.folder_listing(o.join(done, "doc_id", "left"), "C-1")
    return overviews.paged(rows, ["path"], ["sort", "name"]).select("path", "is_file", "name", "processed", "rank")


@query(f"WITH {WIN} SELECT file_id, 'window' AS chunk_method, count(*) AS n_chunks, count_if(length(text) > 1024) AS n_truncated FROM named GROUP BY 1")
def chunk_counts(spark, sf_dir):
    return _windows(spark, sf_dir).groupBy("file_id").agg(F.lit("window").alias("chunk_method"), F.count(F.lit(1)).alias("n_chunks"), F.count_if(F.length("text") > 1024).alias("n_truncated"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, E'\n')) AS line FROM documents), c AS (SELECT doc_id, list_transform(string_split(line, '|'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))) AS cells FROM l)
SELECT doc_id, max(len(cells))::BIGINT AS width, count(*) AS n_rows FROM c WHERE len(cells) >= 2 AND len(list_filter(cells, lambda x: x = '')) = 0 GROUP BY 1""")
def table_widths(spark, sf_dir):
    rows = enrich.table_rows(_docs(spark, sf_dir))
    return rows.groupBy("doc_id").agg(F.max(F.size("cells")).cast("bigint").alias("width"), F.count(F.lit(1)).alias("n_rows"))


@query("""WITH o AS (SELECT n_name AS name, n_nationkey AS id, CASE WHEN n_nationkey % 6 = 0 THEN NULL WHEN n_nationkey % 6 = 1 THEN 99 ELSE n_nationkey - n_nationkey % 6 END AS up FROM nation)
SELECT name, CASE WHEN up IS NULL OR up = 99 THEN 'root' ELSE 'child' END AS place FROM o""")
def orphan_roots(spark, sf_dir):
    k = F.col("n_nationkey")
    n = _t(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), k.alias("id"), F.when(k % 6 == 0, None).when(k % 6 == 1, 99).otherwise(k - k % 6).alias("up"))
    return catalog.top_nodes(n, "id", "up").select("name", F.when(F.col("is_top"), "root").otherwise("child").alias("place"))


@query("""WITH u AS (SELECT 'http://' || lower(r_name) || '/' AS url, r_regionkey AS ord, 'env' AS origin FROM region UNION ALL SELECT 'http://' || lower(r_name), 100 + n_nationkey, 'registry' FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 'http://' || lower(n_name) || '//', 200 + n_nationkey, 'registry' FROM nation WHERE n_nationkey % 2 = 0),
c AS (SELECT rtrim(url, '/') AS url, ord, origin FROM u) SELECT url, min(ord) AS ord, arg_min(origin, ord) AS origin FROM c GROUP BY 1""")
def merged_registries(spark, sf_dir):
    r, n = _t(spark, sf_dir, "region"), _t(spark, sf_dir, "nation")
    url = lambda c, end="": F.concat(F.lit("http://"), F.lower(c), F.lit(end))
    env = r.select(url("r_name", "/").alias("url"), F.col("r_regionkey").alias("ord"))
    known = n.join(r, F.col("r_regionkey") == F.col("n_regionkey")).select(url("r_name").alias("url"), (F.col("n_nationkey") + 100).alias("ord"), F.lit(None).cast("boolean").alias("enabled"))
    own = n.select(url("n_name", "//").alias("url"), (F.col("n_nationkey") + 200).alias("ord"), (F.col("n_nationkey") % 2 == 0).alias("enabled"))
    return catalog.merged_registry([("env", env), ("registry", known.unionByName(own))])


# scopes ---------------------------------------------------------------------------------------

#: members of five scopes: the root, a folder by its id, a collection, an object and a folder that isn't known
SCOPED = f"""{COLL}, f AS (SELECT file_id, min(source_relpath) AS p FROM objects GROUP BY 1), sm AS (SELECT 'root' AS scope, file_id, p AS a, file_id AS b FROM f UNION ALL SELECT 'folder', file_id, min(source_relpath), file_id FROM objects WHERE source_relpath LIKE 'src1/%' GROUP BY 1, 2
UNION ALL SELECT 'collection', file_id, printf('%020d', created), file_id FROM members WHERE name = 'good' UNION ALL SELECT 'object', file_id, p, file_id FROM f WHERE file_id = (SELECT file_id FROM objects WHERE doc_id = 5))"""


def _scoped(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    o, members = corpus.objects(docs), corpus.collections(docs, _t(spark, sf_dir, "labels"))[1]
    folders = catalog.with_folder_ids(catalog.folder_tree(o))
    src1 = folders.where("path = 'src1'").first()["folder_id"]
    good = members.where("name = 'good'").withColumn("collection_id", F.lit("good"))
    one = o.where("doc_id = 5").first()["file_id"]
    out = None
    for name, s in (("root", scopes.Scope()), ("folder", scopes.Scope("folder", src1)), ("collection", scopes.Scope("collection", "good")), ("object", scopes.Scope("object", one)), ("unknown", scopes.Scope("folder", "folder-none"))):
        rows = scopes.scope_members(o, s, good, folders).select(F.lit(name).alias("scope"), "file_id", "ord.a", "ord.b")
        out = rows if out is None else out.unionByName(rows)
    return o, out


@query(f"WITH {SCOPED} SELECT scope, file_id, row_number() OVER (PARTITION BY scope ORDER BY a, b) AS rank FROM sm")
def scope_members(spark, sf_dir):
    return overviews.paged(_scoped(spark, sf_dir)[1], ["scope"], ["a", "b"]).select("scope", "file_id", "rank")


@query(f"WITH {SCOPED}, t AS (SELECT file_id, any_value(CASE WHEN doc_id % 10 = 0 THEN 'edited ' || text ELSE text END) AS text, max(CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END) AS e FROM (SELECT * FROM objects QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY doc_id) = 1) GROUP BY 1) SELECT scope, file_id, CASE WHEN e = 1 THEN 'edited' ELSE 'canonical' END AS representation, text FROM sm JOIN t USING (file_id)")
def scope_member_texts(spark, sf_dir):
    o, members = _scoped(spark, sf_dir)
    one = catalog.first_seen(o, ["file_id"], ["doc_id"])
    edited = one.where("doc_id % 10 = 0").select("file_id", F.concat(F.lit("edited "), F.col("text")).alias("text"))
    return scopes.member_texts(members.select("scope", "file_id"), enrich.preferred_texts(one, edited, "file_id")).select("scope", "file_id", "representation", "text")


# variants -------------------------------------------------------------------------------------

VARIANTS = f"""{OBJ}, v0 AS (SELECT 'object' AS scope_type, file_id AS scope_id, 'synthesis' AS kind, 'firstN' AS method, doc_id AS written, {_first('text', 4000)} AS payload FROM objects WHERE doc_id % 3 = 0 UNION ALL SELECT 'object', file_id, 'synthesis', 'recursive', 1000000 + doc_id, 'written later ' || doc_id FROM objects WHERE doc_id % 9 = 0
UNION ALL SELECT 'object', file_id, 'table', 'rows', doc_id, 't' || doc_id FROM objects WHERE doc_id % 5 = 0 UNION ALL SELECT 'folder', source, 'synthesis', 'firstN', max(doc_id), 'about ' || source FROM objects WHERE source <> 'src4' GROUP BY source),
vs AS (SELECT scope_type, scope_id, kind, method, max(written) AS written, arg_max(payload, written) AS payload FROM v0 WHERE payload <> '' GROUP BY 1, 2, 3, 4),
cur AS (SELECT scope_type, scope_id, arg_max(method, struct_pack(a := written, b := method)) AS method, arg_max(payload, struct_pack(a := written, b := method)) AS payload FROM vs WHERE kind = 'synthesis' GROUP BY 1, 2)"""


def _variants(spark, sf_dir):
    o = _objects(spark, sf_dir)
    named = lambda d, kind, method, written, payload: d.select(F.lit("object").alias("scope_type"), F.col("file_id").alias("scope_id"), F.lit(kind).alias("kind"), F.lit(method).alias("method"), written.cast("bigint").alias("written"), payload.alias("payload"))
    made = artifacts.synthesize(o.where("doc_id % 3 = 0"), "firstN").withColumnRenamed("text", "payload").join(o.select("doc_id", "file_id"), "doc_id")
    rows = named(made, "synthesis", "firstN", F.col("doc_id"), F.col("payload"))
    later = named(o.where("doc_id % 9 = 0"), "synthesis", "recursive", F.col("doc_id") + 1_000_000, F.concat(F.lit("written later "), F.col("doc_id").cast("string")))
    tables = named(o.where("doc_id % 5 = 0"), "table", "rows", F.col("doc_id"), F.concat(F.lit("t"), F.col("doc_id").cast("string")))
    top = F.element_at(F.split("source_relpath", "/"), 1)
    folders = o.groupBy(top.alias("scope_id")).agg(F.max("doc_id").alias("written")).where("scope_id <> 'src4'").select(F.lit("folder").alias("scope_type"), "scope_id", F.lit("synthesis").alias("kind"), F.lit("firstN").alias("method"), "written", F.concat(F.lit("about "), F.col("scope_id")).alias("payload"))
    return artifacts.put_variants(rows, later.unionByName(tables).unionByName(folders))


@query(f"WITH {VARIANTS} SELECT * FROM vs")
def artifact_variants(spark, sf_dir):
    return _variants(spark, sf_dir)


@query(f"WITH {VARIANTS} SELECT * FROM cur")
def current_syntheses(spark, sf_dir):
    return artifacts.current(_variants(spark, sf_dir))


@query(f"""WITH {VARIANTS}, m AS (SELECT 'folder' AS scope_type, source AS scope_id, count(*) AS member_count FROM objects GROUP BY 2)
SELECT m.*, payload IS NOT NULL AS has_synthesis, payload AS synthesis_preview, false AS has_enrichments, 0 AS n_enrichments, true AS can_synthesize, true AS can_enrich FROM m LEFT JOIN cur USING (scope_type, scope_id)""")
def scope_artifacts(spark, sf_dir):
    top = F.element_at(F.split("source_relpath", "/"), 1)
    members = _objects(spark, sf_dir).select(F.lit("folder").alias("scope_type"), top.alias("scope_id"), "file_id")
    return artifacts.scope_summaries(members, _variants(spark, sf_dir))


@query(rf"""WITH {VARIANTS}, {SEG}, n AS (SELECT doc_id, count(*) AS n FROM seg GROUP BY 1), tb AS (SELECT DISTINCT scope_id AS file_id FROM vs WHERE scope_type = 'object' AND kind = 'table')
SELECT o.doc_id, o.file_id, 'doc-' || o.doc_id || '.txt' AS filename, 'text/plain' AS mime, coalesce(n, 0) AS manifest_record_count, coalesce(n, 0) > 0 AS has_extraction, true AS has_preferred_text, 'canonical' AS preferred_text_kind, payload IS NOT NULL AS has_synthesis,
 trim(left(payload, 240), E' \t\n\r\x0b\x0c') AS synthesis_preview, tb.file_id IS NOT NULL AS has_enrichments, false AS preview_available, true AS can_extract, coalesce(n, 0) > 0 AS can_synthesize, coalesce(n, 0) > 0 AS can_enrich, o.doc_id % 13 <> 0 AS source_is_active
FROM (SELECT * FROM objects QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY doc_id) = 1) o LEFT JOIN n USING (doc_id) LEFT JOIN cur ON cur.scope_type = 'object' AND cur.scope_id = o.file_id LEFT JOIN tb ON tb.file_id = o.file_id""")
def object_cards(spark, sf_dir):
    o = catalog.first_seen(_objects(spark, sf_dir), ["file_id"], ["doc_id"])
    states = o.where("doc_id % 13 = 0").select("file_id", F.lit("missing_source").alias("status"))
    preferred = enrich.preferred_texts(o, o.where("false").select("doc_id", "text"), "doc_id")
    return artifacts.object_cards(o, enrich.segments(o, key="doc_id"), preferred, _variants(spark, sf_dir), states)


@query(f"""WITH t AS (SELECT doc_id, unnest(k) AS keyword, generate_subscripts(k, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z][a-z0-9_-][a-z0-9_-]+') AS k FROM documents)),
kw AS (SELECT keyword, count(*) AS n FROM t WHERE NOT contains(' the and for are with that this from into was were have has had but not you your their they them his her its our out all any can may will would should could about there which when what where while than then also such using used use these those within over under after before between because being been each other some more most only very onto upon report document ', ' ' || keyword || ' ') GROUP BY 1 ORDER BY 2 DESC, min(struct_pack(a := doc_id, b := pos)) LIMIT 20)
SELECT 'root' AS scope_type, 'root' AS scope_id, 'table' AS kind, 'stats_keywords' AS method, '{{"keyword":"' || keyword || '","count":' || n || '}}' AS payload FROM kw""")
def enricher_artifacts(spark, sf_dir):
    return artifacts.run_enricher(_docs(spark, sf_dir), "stats_keywords", "root", "root")


@query(rf"""WITH {SEG}, e AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'seg-000001' WHEN doc_id % 3 = 1 THEN 'seg-999999' ELSE '' END AS segment_id, CASE WHEN doc_id % 2 = 0 THEN 'x' END AS t FROM documents WHERE trim(text, E' \t\n\r\x0b\x0c') <> '')
SELECT doc_id, segment_id, CASE WHEN segment_id = '' THEN 'segment id is required' WHEN segment_id = 'seg-999999' THEN 'unknown segment id' ELSE 'text must be a string' END AS problem FROM e WHERE NOT (segment_id = 'seg-000001' AND t IS NOT NULL)""")
def edit_checks(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    sid = F.when(F.col("doc_id") % 3 == 0, " seg-000001").when(F.col("doc_id") % 3 == 1, "seg-999999").otherwise(" ")
    edits = docs.where(text.strip(F.col("text")) != "").select("doc_id", sid.alias("segment_id"), F.when(F.col("doc_id") % 2 == 0, "x").alias("new_text"))
    return artifacts.edit_problems(edits, enrich.segments(docs, key="doc_id"))


@query("SELECT doc_id, doc_id % 10 = 0 AND doc_id % 20 <> 0 AS embeddings, doc_id % 10 = 0 AND doc_id % 20 <> 0 AS search_chunks FROM documents")
def stale_objects(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    edits = docs.where("doc_id % 10 = 0").select("doc_id", F.lit("seg-000001").alias("segment_id"), F.lit("x").alias("new_text"))
    return artifacts.stale(docs, artifacts.without_edits(edits, docs.where("doc_id % 20 = 0")))


# collections and reconciliation -----------------------------------------------------------------

EDITED = """had AS (SELECT 'col-' || left(sha256(r_name), 12) AS collection_id, r_name AS name, 'a region' AS description, NULL AS kind, NULL AS color FROM region),
asked AS (SELECT n_nationkey AS ord, CASE WHEN n_nationkey % 8 = 0 THEN ' ' WHEN n_nationkey % 8 = 1 THEN 'ASIA' WHEN n_nationkey % 8 = 2 THEN 'twice' ELSE n_name END AS name, n_nationkey % 2 = 0 AS listed FROM nation),
good AS (SELECT 'col-' || left(sha256(name), 12) AS collection_id, name, NULL AS description, CASE WHEN listed THEN 'file-list' ELSE 'manual' END AS kind, NULL AS color FROM asked WHERE trim(name) <> '' AND name NOT IN (SELECT name FROM had) QUALIFY row_number() OVER (PARTITION BY name ORDER BY ord) = 1),
made AS (SELECT *, 1 AS updated FROM had UNION ALL SELECT *, 5 FROM good),
done AS (SELECT collection_id, CASE WHEN name = 'ASIA' THEN 'Asia renamed' ELSE name END AS name, CASE WHEN name = 'EUROPE' THEN 'new words' ELSE description END AS description, kind, color, CASE WHEN name IN ('ASIA', 'EUROPE') THEN 9 ELSE updated END AS updated FROM made WHERE name <> 'AFRICA')"""


def _edited(spark, sf_dir):
    n, r = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "region")
    none = F.lit(None).cast("string")
    had = r.select(curation.collection_id(F.col("r_name")).alias("collection_id"), F.col("r_name").alias("name"), F.lit("a region").alias("description"), none.alias("kind"), none.alias("color"), F.lit(1).alias("created"), F.lit(1).alias("updated"))
    k = F.col("n_nationkey")
    name = F.when(k % 8 == 0, " ").when(k % 8 == 1, " ASIA").when(k % 8 == 2, "twice ").otherwise(F.col("n_name"))
    asked = n.select(k.alias("ord"), name.alias("name"), none.alias("description"), F.when(k % 2 == 0, " file-list ").alias("kind"), none.alias("color"))
    made = curation.created(had, asked, F.lit(5))
    new_name = F.when(F.col("name") == "ASIA", " Asia renamed ").when(F.col("name") == "AMERICA", " ")
    changes = had.select("collection_id", new_name.alias("name"), F.when(F.col("name") == "EUROPE", "new words").alias("description"), none.alias("kind"), none.alias("color"))
    left, _ = curation.deleted(curation.updated(made, changes, F.lit(9)), had.select("collection_id", F.lit("f").alias("file_id")), had.where("name = 'AFRICA'"))
    return left


@query(f"WITH {EDITED} SELECT collection_id, name, description, coalesce(kind, 'manual') AS kind, updated, 0 AS document_count FROM done")
def collections_after_edits(spark, sf_dir):
    left = _edited(spark, sf_dir)
    return curation.records(left, left.select("collection_id").where("false")).select("collection_id", "name", "description", "kind", "updated", "document_count")


@query(f"WITH {EDITED} SELECT n_name AS name, collection_id FROM nation LEFT JOIN done ON done.name = n_name")
def collections_by_name(spark, sf_dir):
    return curation.found_by_name(_edited(spark, sf_dir), _t(spark, sf_dir, "nation").select(F.col("n_name").alias("name")))


@query(f"{RECON}, w AS (SELECT coalesce(new_file_id, file_id) AS file_id, CASE WHEN state = 'missing' THEN 'missing_source' ELSE 'active' END AS status, coalesce(moved_to, source_relpath) AS source_relpath FROM allr) SELECT file_id, status, source_relpath FROM w QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY status, source_relpath) = 1")
def reconciled_states(spark, sf_dir):
    return catalog.reconciled_states(_reconciled(spark, sf_dir))


@query(f"{RECON} SELECT coalesce(new_file_id, file_id) AS file_id, coalesce(moved_to, source_relpath) AS source_relpath, CASE WHEN state IN ('changed', 'new') OR coalesce(new_file_id, file_id) NOT IN (SELECT file_id FROM objects) THEN 'extract' ELSE 'keep' END AS work FROM allr")
def reconciled_catalog(spark, sf_dir):
    return catalog.apply_reconciliation(_objects(spark, sf_dir), _reconciled(spark, sf_dir))


# checks ---------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT n_nationkey AS ord, CASE WHEN n_nationkey = 3 THEN '' WHEN n_nationkey = 7 THEN 'BRAZIL' ELSE n_name END AS name, CASE WHEN n_nationkey = 5 THEN NULL ELSE 'x' || n_regionkey END AS extractor, CASE WHEN n_nationkey = 9 THEN [] WHEN n_nationkey IN (20, 22) THEN ['*'] WHEN n_nationkey = 11 THEN ['pdf'] ELSE ['.' || left(lower(n_name), 1)] END AS exts FROM nation),
e AS (SELECT ord, unnest(exts) AS ext FROM r)
SELECT ord, 'error' AS level, 'no name' AS problem FROM r WHERE name = '' UNION ALL SELECT ord, 'error', 'name is taken' FROM r WHERE name <> '' QUALIFY row_number() OVER (PARTITION BY name ORDER BY ord) > 1 UNION ALL SELECT ord, 'error', 'no extractor' FROM r WHERE extractor IS NULL
UNION ALL SELECT ord, 'warning', 'unknown extractor' FROM r WHERE extractor = 'x4' UNION ALL SELECT ord, 'warning', 'disabled extractor' FROM r WHERE extractor = 'x3' UNION ALL SELECT ord, 'error', 'no extensions' FROM r WHERE len(exts) = 0 UNION ALL SELECT ord, 'error', 'extension without a dot' FROM r WHERE exts = ['pdf']
UNION ALL SELECT 22, 'error', 'second catch-all' UNION ALL SELECT ord, 'warning', 'catch-all is not last' FROM r WHERE ord IN (20, 22) UNION ALL SELECT ord, 'warning', 'after a catch-all' FROM r WHERE ord > 20 AND ord <> 22 AND len(exts) > 0
UNION ALL SELECT ord, 'warning', 'matched earlier: ' || ext FROM e WHERE ext <> '*' QUALIFY row_number() OVER (PARTITION BY ext ORDER BY ord) > 1""")
def route_checks(spark, sf_dir):
    n, k = _t(spark, sf_dir, "nation"), F.col("n_nationkey")
    name = F.when(k == 3, "").when(k == 7, "BRAZIL").otherwise(F.col("n_name"))
    exts = F.when(k == 9, F.array().cast("array<string>")).when(k.isin(20, 22), F.array(F.lit("*"))).when(k == 11, F.array(F.lit("pdf"))).otherwise(F.array(F.concat(F.lit(" ."), F.left("n_name", F.lit(1)))))
    routes = n.select(k.alias("ord"), name.alias("name"), F.when(k != 5, F.concat(F.lit("x"), F.col("n_regionkey").cast("string"))).alias("extractor"), exts.alias("extensions"))
    known = _t(spark, sf_dir, "region").where("r_regionkey < 4").select(F.concat(F.lit("x"), F.col("r_regionkey").cast("string")).alias("id"), (F.col("r_regionkey") != 3).alias("enabled"))
    return checks.route_problems(routes, known)


@query("""SELECT event_id, 'repeated column key' AS problem FROM events WHERE event_id % 3 = user_id % 3 UNION ALL SELECT event_id, 'provenance of some rows only' FROM events WHERE event_id % 5 <> 0 AND event_id % 5 <> user_id % 5""")
def table_checks(spark, sf_dir):
    e, k, u = _t(spark, sf_dir, "events"), F.col("event_id"), F.col("user_id")
    tables = e.select(k, F.array((k % 3).cast("string"), (u % 3).cast("string")).alias("columns"), (u % 5).alias("n_rows"), (k % 5).alias("n_provenance"))
    return checks.table_problems(tables, "event_id")


@query("SELECT vec_id, CASE WHEN vec_id % 11 = 3 THEN 'missing' WHEN vec_id % 11 = 4 THEN 'empty' ELSE 'another length' END AS problem FROM embeddings WHERE vec_id % 11 IN (3, 4, 5)")
def response_checks(spark, sf_dir):
    k, v = F.col("vec_id") % 11, F.col("embedding")
    e = _t(spark, sf_dir, "embeddings").select("vec_id", F.when(k == 3, None).when(k == 4, F.slice(v, 1, 0)).when(k == 5, F.slice(v, 1, 9)).otherwise(v).alias("embedding"))
    return checks.response_problems(e, dims=64)


# page regions, prompts, embeddings --------------------------------------------------------------

REGIONS = """g AS (SELECT event_id AS region_id, user_id AS page, event_id % 600 AS x, event_id % 97 * 8 AS y, event_id % 590 + 5 AS width, user_id % 395 + 3 AS height, ((event_id % 590 + 5) * (user_id % 395 + 3))::DOUBLE AS area FROM events),
u AS (SELECT * FROM g WHERE area >= 900 AND width >= 12 AND height >= 8 AND NOT (width > floor(600 * 0.98) AND height > floor(400 * 0.98)))"""


@query(f"WITH {REGIONS}, r AS (SELECT page, region_id, row_number() OVER (PARTITION BY page ORDER BY y, x, region_id) AS rank FROM u) SELECT * FROM r WHERE rank <= 200")
def page_regions(spark, sf_dir):
    k, u = F.col("event_id"), F.col("user_id")
    e = _t(spark, sf_dir, "events").select(k.alias("region_id"), u.alias("page"), (k % 600).alias("x"), (k % 97 * 8).alias("y"), (k % 590 + 5).alias("width"), (u % 395 + 3).alias("height"), F.lit(600).alias("page_width"), F.lit(400).alias("page_height"))
    usable = regions.usable_regions(e.withColumn("area", (F.col("width") * F.col("height")).cast("double")), 900, 12, 8)
    return regions.in_reading_order(usable, 200).select("page", "region_id", "rank")


@query("""WITH w AS (SELECT user_id AS region_id, event_id AS ord, CASE WHEN event_id % 4 = 0 OR user_id % 9 = 0 THEN '' ELSE event_type END AS t, CASE WHEN event_id % 5 = 0 THEN -1 ELSE event_id % 130 END AS conf FROM events),
j AS (SELECT region_id, coalesce(string_agg(t, ' ' ORDER BY ord) FILTER (t <> ''), '') AS text, avg(conf / 100.0::DOUBLE) FILTER (t <> '' AND conf >= 0) AS c FROM w GROUP BY 1), z AS (SELECT region_id, text, CASE WHEN text = '' THEN 0.0 ELSE greatest(0.0, least(1.0, coalesce(c, 1.0))) END AS confidence FROM j)
SELECT region_id, text, round(confidence, 6)::DOUBLE AS confidence FROM z WHERE text <> '' AND confidence >= 0.4""")
def region_texts(spark, sf_dir):
    k = F.col("event_id")
    words = _t(spark, sf_dir, "events").select(F.col("user_id").alias("region_id"), k.alias("ord"), F.when((k % 4 == 0) | (F.col("user_id") % 9 == 0), " ").otherwise(F.col("event_type")).alias("text"), F.when(k % 5 == 0, F.lit(-1)).otherwise(k % 130).alias("conf"))
    return regions.read_regions(regions.region_texts(words), 0.4).withColumn("confidence", F.round("confidence", 6))


@query(r"""WITH e AS (SELECT conv_id, turn, coalesce(role, '') || ': ' || coalesce(text, '') AS line FROM conversations) SELECT conv_id, string_agg(line, E'\n' ORDER BY turn) AS history, count(*) AS turns FROM e GROUP BY 1""")
def chat_history(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations")
    line = F.concat(F.coalesce("role", F.lit("")), F.lit(": "), F.coalesce("text", F.lit("")))
    return c.groupBy("conv_id").agg(text.ordered_text(F.col("turn"), line, "\n").alias("history"), F.count(F.lit(1)).alias("turns"))


@query(rf"""WITH {WIN}, cut AS (SELECT chunk_id, CASE WHEN length(text) > 1024 THEN rtrim(left(text, 1024), E' \t\n\r\x0b\x0c') ELSE text END AS t FROM named),
v AS (SELECT chunk_id, list_transform(range(0, 8), lambda i: ('0x' || substr(sha256(t), (2 * i + 1)::INT, 2))::INT - 127.5) AS v FROM cut)
SELECT chunk_id, 'done' AS status, {", ".join(f"round(v[{i + 1}] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6)::DOUBLE AS e{i}" for i in range(8))} FROM v""")
def embedded_chunks(spark, sf_dir):
    e = embedding.embed(_windows(spark, sf_dir), embedding.toy_client)
    return e.select("chunk_id", "status", *[F.round(F.get("embedding", F.lit(i)), 6).alias(f"e{i}") for i in range(8)])
