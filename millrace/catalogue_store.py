"""Queries over the written corpus: what is left of several commits, and searches of an index that follows edits."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.catalogue import ASKED, BM, OBJ, SEG, _docs, _first, _objects, _t, query
from millrace.operators import chunking, enrich
from millrace.plans import search as plans
from millrace.plans.store import CorpusStore
from millrace.session import shared_dir
from millrace.sources import corpus
from millrace.streaming import runs

_STORES: dict[tuple[str, str, str], object] = {}


def _once(spark, sf_dir: str, what: str, make):
    """What several queries of a session read is written once."""
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _STORES:
        _STORES[key] = make(f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}")
    return _STORES[key]


# artifacts in several commits --------------------------------------------------------------------


def _variant(rows: DataFrame, scope_type: str, scope_id, kind: str, method: str, payload, day: int) -> DataFrame:
    return rows.select(F.lit(scope_type).alias("scope_type"), scope_id.alias("scope_id"), F.lit(kind).alias("kind"), F.lit(method).alias("method"), payload.alias("payload"), F.lit('{"day": %d}' % day).alias("metadata"), F.lit(f"2026-01-{day:02d} 00:00:00").cast("timestamp").alias("written"))


def _artifact_store(spark, sf_dir) -> CorpusStore:
    def make(path: str) -> CorpusStore:
        store, docs = CorpusStore(spark, path), _docs(spark, sf_dir)
        file_id, colls = F.concat(F.lit("doc-"), F.col("doc_id").cast("string")), corpus.collections(docs, _t(spark, sf_dir, "labels"))[0]
        first = enrich.first_n(docs, 300)
        store.put_artifacts(_variant(first, "object", file_id, "synthesis", "first N", F.col("text"), 1).unionByName(_variant(colls, "collection", F.col("collection_id"), "synthesis", "wiki", F.concat(F.lit("pages of "), F.col("name")), 1)))
        again = _variant(docs.where("doc_id % 3 = 0"), "Object", file_id, "synthesis", " first N ", F.concat(F.lit("rewritten "), F.col("doc_id").cast("string")), 2)
        words = _variant(docs.where("doc_id % 5 = 0"), "object", file_id, "key words", "by count", F.to_json(F.struct("doc_id")), 2)
        root = _variant(spark.range(1), "root", F.lit("whatever"), "synthesis", "overview", F.lit("  all of it "), 2)
        store.put_artifacts(again.unionByName(words).unionByName(root))
        store.delete_artifacts(docs.where("doc_id % 7 = 0").select(F.lit("object").alias("scope_type"), file_id.alias("scope_id")))
        return store

    return _once(spark, sf_dir, "artifact-store", make)


ARTIFACTS = rf"""colls AS (SELECT DISTINCT 'col-' || left(sha256(name), 12) AS id, name FROM (SELECT 'good' AS name FROM labels JOIN documents USING (doc_id) WHERE quality = 1 UNION ALL SELECT 'toxic' FROM labels JOIN documents USING (doc_id) WHERE toxic = 1)),
v1 AS (SELECT 'object' AS scope_type, 'doc-' || doc_id AS scope_id, 'synthesis' AS kind, 'first_N' AS base, {_first('text', 300)} AS payload, 1 AS day, doc_id FROM documents UNION ALL SELECT 'collection', id, 'synthesis', 'wiki', 'pages of ' || name, 1, NULL FROM colls),
v2 AS (SELECT * FROM v1 WHERE scope_type <> 'object' OR doc_id % 3 <> 0 UNION ALL SELECT 'object', 'doc-' || doc_id, 'synthesis', 'first_N', 'rewritten ' || doc_id, 2, doc_id FROM documents WHERE doc_id % 3 = 0
 UNION ALL SELECT 'object', 'doc-' || doc_id, 'key words', 'key_words--by_count', '{{"doc_id":' || doc_id || '}}', 2, doc_id FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT 'root', 'root', 'synthesis', 'overview', '  all of it ', 2, NULL),
v3 AS (SELECT * FROM v2 WHERE scope_type <> 'object' OR doc_id % 7 <> 0),
held AS (SELECT *, CASE scope_type WHEN 'object' THEN 'objects/' || scope_id || '/' WHEN 'collection' THEN 'collections/' || scope_id || '/' ELSE '' END || CASE kind WHEN 'synthesis' THEN 'syntheses/' ELSE 'enrichments/' END || base AS path FROM v3)"""


@query(f"WITH {ARTIFACTS} SELECT scope_type, scope_id, kind, base, payload, '{{\"day\": ' || day || '}}' AS metadata, path || CASE kind WHEN 'synthesis' THEN '.txt' ELSE '.json' END AS data_path, path || CASE kind WHEN 'synthesis' THEN '.json' ELSE '.meta.json' END AS metadata_path FROM held")
def stored_artifacts(spark, sf_dir):
    return _artifact_store(spark, sf_dir).artifacts().drop("method", "written")


@query(f"WITH {ARTIFACTS} SELECT 1::BIGINT AS version, count(*) AS n, sum(length(payload))::BIGINT AS total FROM v1 UNION ALL SELECT 2, count(*), sum(length(payload)) FROM v2 UNION ALL SELECT 3, count(*), sum(length(payload)) FROM v3")
def stored_versions(spark, sf_dir):
    store = _artifact_store(spark, sf_dir)
    each = [store.artifacts(version=v).agg(F.lit(v).cast("bigint").alias("version"), F.count(F.lit(1)).alias("n"), F.sum(F.length("payload")).alias("total")) for v in (1, 2, 3)]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query(rf"""WITH {ARTIFACTS}, m AS (SELECT 'object' AS scope_type, 'doc-' || doc_id AS scope_id, count(*) AS n FROM documents GROUP BY 1, 2
 UNION ALL SELECT 'collection', 'col-' || left(sha256(name), 12), count(DISTINCT doc_id) FROM (SELECT 'good' AS name, doc_id FROM labels WHERE quality = 1 UNION ALL SELECT 'toxic', doc_id FROM labels WHERE toxic = 1) SEMI JOIN documents USING (doc_id) GROUP BY 1, 2
 UNION ALL SELECT 'root', 'root', (SELECT count(*) FROM documents) UNION ALL SELECT 'folder', 'nothing', 0),
a AS (SELECT scope_type, scope_id, count_if(kind = 'synthesis') AS s, count_if(kind <> 'synthesis') AS e, min(CASE WHEN kind = 'synthesis' THEN base || '.json' END) AS f, max(CASE WHEN kind = 'synthesis' THEN payload END) AS p FROM held GROUP BY 1, 2)
SELECT scope_type, scope_id, n AS member_count, coalesce(s, 0) > 0 AS has_synthesis, CASE WHEN scope_type = 'collection' THEN f WHEN length(p) > 0 THEN trim(left(p, 240), E' \t\n\r\x0b\x0c') END AS synthesis_preview, 2 * coalesce(s, 0) AS n_syntheses, coalesce(e, 0) > 0 AS has_enrichments, 2 * coalesce(e, 0) AS n_enrichments,
 n > 0 AS can_synthesize, n > 0 AS can_enrich FROM m LEFT JOIN a USING (scope_type, scope_id)""")
def stored_scope_summaries(spark, sf_dir):
    docs, labels = _docs(spark, sf_dir), _t(spark, sf_dir, "labels")
    file_id = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    member = lambda rows, kind, id_, what: rows.select(F.lit(kind).alias("scope_type"), id_.alias("scope_id"), what.alias("file_id"))
    named = labels.join(docs, "doc_id", "left_semi").select("doc_id", F.explode(F.array_compact(F.array(F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic")))).alias("name")).distinct()
    members = member(docs, "object", file_id, file_id).unionByName(member(named, "collection", F.concat(F.lit("col-"), F.left(F.sha2("name", 256), F.lit(12))), file_id)).unionByName(member(docs, "root", F.lit("root"), file_id))
    return _artifact_store(spark, sf_dir).scope_summaries(members.unionByName(member(spark.range(1), "folder", F.lit("nothing"), F.lit(None).cast("string"))))


@query(f"WITH {ARTIFACTS}, f AS (SELECT scope_type, scope_id, kind, unnest([path || CASE kind WHEN 'synthesis' THEN '.txt' ELSE '.json' END, path || CASE kind WHEN 'synthesis' THEN '.json' ELSE '.meta.json' END]) AS relpath FROM held) SELECT scope_type, scope_id, CASE kind WHEN 'synthesis' THEN 'syntheses' ELSE 'enrichments' END AS part, string_split(relpath, '/')[-1] AS name, relpath FROM f")
def artifact_listing(spark, sf_dir):
    return _artifact_store(spark, sf_dir).listing()


# provenance --------------------------------------------------------------------------------------


@query("""SELECT 'doc-' || doc_id AS file_id, CASE WHEN doc_id % 11 = 0 THEN 'error' WHEN doc_id % 4 = 0 THEN 'done' ELSE 'running' END AS status, CASE WHEN doc_id % 4 = 0 THEN 'plain-2' ELSE 'plain-1' END AS extractor_name, lang, CASE WHEN doc_id % 6 = 0 THEN 'firstN' END AS synthesizer_name, CASE WHEN doc_id % 6 = 0 THEN doc_id % 12 = 0 END AS expert_context_used FROM documents""")
def stored_provenance(spark, sf_dir):
    store, docs = CorpusStore(spark, f"{shared_dir(spark)}/provenance-{uuid.uuid4().hex}"), _docs(spark, sf_dir)
    k, file_id = F.col("doc_id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("file_id")
    store.write_provenance(docs.select(file_id, F.lit("running").alias("status"), F.lit("plain-1").alias("extractor_name"), "lang"))
    # a second run of some objects, then its synthesizer, which leaves the rest as it is, then what failed
    store.write_provenance(docs.where("doc_id % 4 = 0").select(file_id, F.lit("done").alias("status"), F.lit("plain-2").alias("extractor_name"), "lang"))
    store.note_synthesis(docs.where("doc_id % 6 = 0").select(file_id, F.lit("firstN").alias("synthesizer_name"), (k % 12 == 0).alias("expert_context_used")))
    store.table("provenance").update(docs.where("doc_id % 11 = 0").select(file_id, F.lit("error").alias("status")))
    return store.table("provenance").read()


# edits and the index -----------------------------------------------------------------------------

EDITED = rf"""{SEG}, objects AS (SELECT doc_id, 'doc-' || doc_id AS file_id, source || '/' || lang || '/doc-' || doc_id || '.txt' AS source_relpath, doc_id % 10 = 0 AND doc_id % 20 <> 0 AS edited,
 trim(string_agg(CASE WHEN doc_id % 10 = 0 AND doc_id % 20 <> 0 AND ord = 1 THEN 'Edited under the License, version ' || doc_id ELSE seg.text END, E'\n\n' ORDER BY ord), E' \t\n\r\x0b\x0c') AS text FROM seg JOIN documents d USING (doc_id) WHERE doc_id % 13 <> 5 GROUP BY doc_id, source, lang)"""
EDITED_BM = BM.replace(OBJ, EDITED).replace("'chunk-' || doc_id", "'chunk-' || file_id")
EDITED_HITS = rf"""WITH {EDITED_BM} SELECT lex.source_relpath, chunk_id, round(score, 6) AS score, trim(left(lex.text, 400), E' \t\n\r\x0b\x0c') AS snippet, CASE WHEN edited THEN 'edited' ELSE 'canonical' END AS source_text_representation, CASE WHEN edited THEN 'edited_text' ELSE 'canonical_extracted_text' END AS source_text_kind, 'window' AS chunk_method
FROM lex JOIN objects o ON o.doc_id = lex.doc_id ORDER BY round(lex.score, 9) DESC, lex.source_relpath, chunk_id LIMIT"""


def _edited(spark, sf_dir):
    """A store and its index: all texts, then edits, some taken back, and objects that go; the index is updated for what is stale."""

    def make(path: str):
        store, docs = CorpusStore(spark, path), _docs(spark, sf_dir)
        file_id = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
        objects = _objects(spark, sf_dir).select("doc_id", file_id.alias("file_id"), "source_relpath", "text")
        store.write_objects(objects.select("file_id", "source_relpath"))
        store.write_segments(enrich.segments(objects.select("file_id", "text")))
        records = lambda files=None: chunking.chunk_records(store.table("objects").read(), store.preferred(files), "window")
        index = plans.build(records(), f"{path}/index")
        store.put_edits(docs.where("doc_id % 10 = 0").select(file_id.alias("file_id"), F.lit("seg-000001").alias("segment_id"), F.concat(F.lit("Edited under the License, version "), F.col("doc_id").cast("string")).alias("text")))
        index.update(store.stale(), records(store.stale()))
        store.rebuilt(store.stale())
        store.delete_edits(docs.where("doc_id % 20 = 0").select(file_id.alias("file_id")))
        index.update(store.stale(), records(store.stale()))
        store.rebuilt(store.stale())
        index.delete(docs.where("doc_id % 13 = 5").select(file_id.alias("file_id")))
        return store, index

    return _once(spark, sf_dir, "edited-store", make)


def _hits(found: DataFrame) -> DataFrame:
    return found.select("source_relpath", "chunk_id", F.round("score", 6).alias("score"), "snippet", "source_text_representation", "source_text_kind", "chunk_method")


@query(f"{EDITED_HITS} 30")
def search_after_edits(spark, sf_dir):
    return _hits(plans.search(_edited(spark, sf_dir)[1], ASKED, top_k=30))


@query(f"WITH {EDITED_BM} SELECT (SELECT n FROM st) AS n_chunks, round((SELECT avgdl FROM st), 6) AS avgdl, (SELECT count(*) FROM (SELECT DISTINCT chunk_id, term FROM tok)) AS n_postings")
def index_after_edits(spark, sf_dir):
    index = _edited(spark, sf_dir)[1]
    n, avgdl = index.stats()
    return index.postings().agg(F.lit(n).cast("bigint").alias("n_chunks"), F.lit(round(avgdl or 0.0, 6)).alias("avgdl"), F.count(F.lit(1)).alias("n_postings"))


@query(f"{EDITED_HITS} 20")
def search_after_merge(spark, sf_dir):
    def make(path: str):
        store, index = _edited(spark, sf_dir)
        whole = plans.build(index.chunks().drop("shard").limit(0), path)
        # the live rows of the edited index as an update of an empty one, then in one part
        live = index.chunks().drop("shard")
        return whole.update(live, live).merge()

    return _hits(plans.search(_once(spark, sf_dir, "merged-index", make), ASKED, top_k=20))


@query(rf"WITH {EDITED} SELECT file_id, CASE WHEN edited THEN 'edited' ELSE 'canonical' END AS representation, CASE WHEN edited THEN 'edited_text' ELSE 'canonical_extracted_text' END AS kind, text FROM objects UNION ALL SELECT 'doc-' || doc_id, 'canonical', 'canonical_extracted_text', NULL FROM documents WHERE false")
def stored_texts(spark, sf_dir):
    store, _ = _edited(spark, sf_dir)
    gone = _docs(spark, sf_dir).where("doc_id % 13 = 5").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("file_id"))
    return store.preferred().join(gone, "file_id", "left_anti")


# runs --------------------------------------------------------------------------------------------

#: a run that is taken and says nothing for so many seconds is lost
LEASE = 86_400
KINDS = {"signup": "queued", "click": "claimed", "view": "item", "purchase": "done", "error": "error"}


def _run_log(spark, sf_dir) -> DataFrame:
    """Events as those of runs, streamed from their files into a log that is only added to."""

    def make(path: str) -> str:
        schema = _t(spark, sf_dir, "events").schema
        kind = F.element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), F.col("event_type"))
        events = runs.events_of(spark, f"{sf_dir}/[e]vents.parquet", schema)  # a pattern: the table may be one file
        events = events.select(F.col("user_id").alias("run_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), kind.alias("event"), F.format_string("%s %d", F.col("event_type"), F.col("event_id")).alias("message"))
        runs.publish_runs(events, f"{path}/log", f"{path}/mark", LEASE).awaitTermination()
        return f"{path}/log"

    return spark.read.parquet(_once(spark, sf_dir, "run-log", make))


RUN_LOG = f"""RECURSIVE e AS (SELECT user_id::VARCHAR AS run_id, epoch_us(ts) AS us, event_type || ' ' || event_id AS message, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'click' THEN 'claimed' WHEN 'view' THEN 'item' WHEN 'purchase' THEN 'done' ELSE 'error' END AS event,
 row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT DISTINCT run_id, 0::BIGINT AS k, 0::BIGINT AS n, NULL::BIGINT AS us, NULL::VARCHAR AS event, NULL::VARCHAR AS message, false AS lost, NULL::BIGINT AS lost_at, NULL::VARCHAR AS status, false AS accepted, 0::BIGINT AS completed, 0::BIGINT AS before, NULL::BIGINT AS deadline, NULL::BIGINT AS created FROM e
 UNION ALL SELECT run_id, k, n + 1 + lost::BIGINT, us, event, message, lost, lost_at, coalesce(new, p), new IS NOT NULL, CASE WHEN new IS NULL THEN completed WHEN event = 'queued' THEN 0 WHEN event = 'item' THEN completed + 1 ELSE completed END, completed,
  CASE WHEN coalesce(new, p) <> 'running' OR coalesce(new, p) IS NULL THEN NULL WHEN new IS NULL THEN deadline ELSE us // 1000 + {LEASE * 1000} END, CASE WHEN new = 'pending' THEN us ELSE created END
 FROM (SELECT *, CASE WHEN event = 'queued' AND (p IS NULL OR p IN ('done', 'error')) THEN 'pending' WHEN event = 'claimed' AND p = 'pending' THEN 'running' WHEN event = 'item' AND p = 'running' THEN 'running' WHEN event = 'done' AND p = 'running' THEN 'done' WHEN event = 'error' AND p IN ('pending', 'running') THEN 'error' END AS new
  FROM (SELECT e.run_id, e.k, f.n, e.us, e.event, e.message, f.completed, f.created, f.deadline, coalesce(f.deadline < e.us // 1000, false) AS lost, CASE WHEN f.deadline < e.us // 1000 THEN f.deadline * 1000 END AS lost_at, CASE WHEN f.deadline < e.us // 1000 THEN 'error' ELSE f.status END AS p FROM f JOIN e ON e.run_id = f.run_id AND e.k = f.k + 1))),
fin AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY k DESC) = 1),
log AS (SELECT run_id, n, us, event, accepted, status, completed, message, created FROM f WHERE k > 0 UNION ALL SELECT run_id, n - 1, lost_at, 'lost', true, 'error', before, 'no sign of its worker', created FROM f WHERE lost
 UNION ALL SELECT run_id, n + 1, deadline * 1000, 'lost', true, 'error', completed, 'no sign of its worker', created FROM fin WHERE deadline <= (SELECT max(us) // 1000 FROM e))"""


@query(f"WITH {RUN_LOG} SELECT run_id, n, us, event, accepted, status, completed, message FROM log")
def run_log(spark, sf_dir):
    return _run_log(spark, sf_dir).select("run_id", "n", F.unix_micros("at").alias("us"), "event", "accepted", "status", "completed", "message")


@query(f"WITH {RUN_LOG} SELECT run_id, arg_max(status, n) AS status, arg_max(completed, n) AS completed, max(n) AS n_log, CASE WHEN arg_max(status, n) = 'error' THEN arg_max(message, CASE WHEN accepted AND event IN ('error', 'lost') THEN n END) END AS message FROM log GROUP BY 1")
def run_states(spark, sf_dir):
    return runs.runs(_run_log(spark, sf_dir)).select("run_id", "status", "completed", "n_log", "message")


@query(f"WITH {RUN_LOG} SELECT run_id, us FROM (SELECT run_id, arg_max(status, n) AS status, max(CASE WHEN accepted AND event = 'queued' THEN us END) AS us FROM log GROUP BY 1) WHERE status = 'pending' ORDER BY us, run_id LIMIT 1")
def run_next(spark, sf_dir):
    return runs.next_run(_run_log(spark, sf_dir)).select("run_id", F.unix_micros("created_at").alias("us"))
