"""Queries over pages, processors' answers, needles in segments and many questions at once, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.catalogue import FOLDERS, SEG, WIN, _docs, _index, _objects, _t, query
from millrace.operators import catalog, contract, enrich, grams, manifests, pages
from millrace.operators.scopes import Scope
from millrace.plans import batch
from millrace.plans.store import CorpusStore
from millrace.session import shared_dir
from millrace.sources import bundles

# pages -------------------------------------------------------------------------------------------


def _lines(html: str):
    """A stand-in for a model that sees pages: a box for each line, pictures where the line has one, and pages that it can't read."""
    if len(html) % 7 == 0:
        raise ValueError(f"{len(html)} characters")
    lines = html.split("\n")
    return 100, 100, [{"type": "Picture" if "<a" in line else "Text", "text": line, "bbox": {"xmin": (i % 10) / 10, "ymin": 0.5, "xmax": 0.3, "ymax": 0.1}} for i, line in enumerate(lines)]


def _regions(spark, sf_dir):
    p = _t(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 5).alias("doc_id"), (F.col("page_id") % 5 + 1).cast("int").alias("page"), F.col("html").alias("content"))
    return pages.page_regions(p, _lines)


PAGES = r"""p AS (SELECT page_id // 5 AS doc_id, (page_id % 5 + 1)::INT AS page, html, length(html) % 7 = 0 AS bad FROM pages),
ln AS (SELECT doc_id, page, unnest(string_split(html, E'\n')) AS line, generate_subscripts(string_split(html, E'\n'), 1) - 1 AS i FROM p WHERE NOT bad),
txt AS (SELECT doc_id, page, coalesce(string_agg(trim(line, E' \t\n\r\x0b\x0c'), E'\n\n' ORDER BY i) FILTER (trim(line, E' \t\n\r\x0b\x0c') <> ''), '') AS text, count(*) AS n_regions, count_if(contains(line, '<a') AND i % 10 <> 3) AS n_pictures FROM ln GROUP BY 1, 2),
bad AS (SELECT doc_id, min(page) AS first FROM p WHERE bad GROUP BY 1),
kept AS (SELECT p.doc_id, p.page, CASE WHEN NOT bad THEN coalesce(text, '') END AS text, coalesce(n_regions, 0) AS n_regions, coalesce(n_pictures, 0) AS n_pictures, CASE WHEN bad THEN length(html) || ' characters' END AS error FROM p LEFT JOIN txt USING (doc_id, page) LEFT JOIN bad USING (doc_id) WHERE first IS NULL OR page <= first)"""


@query(f"WITH {PAGES} SELECT doc_id, page, 'seg-' || lpad(page::VARCHAR, 6, '0') AS segment_id, sha256(text) AS text, n_regions, n_pictures, error FROM kept")
def read_pages(spark, sf_dir):
    return pages.read_pages(_regions(spark, sf_dir)).withColumn("text", F.sha2("text", 256))


@query(f"WITH {PAGES} SELECT doc_id, CASE WHEN count(error) = 0 THEN 'done' WHEN count(*) > count(error) THEN 'partial' ELSE 'error' END AS status, count(*) - count(error) AS pages_done, count(*) AS pages_tried, min(error) AS error FROM kept GROUP BY 1")
def page_states(spark, sf_dir):
    return pages.document_states(pages.read_pages(_regions(spark, sf_dir)))


@query(f"""WITH {PAGES}, pic AS (SELECT doc_id, page, i, row_number() OVER (PARTITION BY doc_id ORDER BY page, i) AS n FROM ln SEMI JOIN (SELECT * FROM kept WHERE error IS NULL) USING (doc_id, page) WHERE contains(line, '<a') AND i % 10 <> 3)
SELECT doc_id, page, 'artifact-' || lpad(n::VARCHAR, 6, '0') AS artifact_id, least(i % 10 * 10, 30)::INT AS x1, 10 AS y1, greatest(i % 10 * 10, 30)::INT AS x2, 50 AS y2 FROM pic""")
def page_pictures(spark, sf_dir):
    regions = _regions(spark, sf_dir)
    return pages.picture_names(regions, pages.read_pages(regions))


# answers of processors ---------------------------------------------------------------------------

_WRAP = '{"api_version":"v1","request_id":"r","processor":{},"artifacts":[%s]}'
_ITEM = '{"id":"%s","kind":"%s","media_type":"application/json",%s}'
_TABLE = '"standard_data":{"artifact_type":"table","title":"t","columns":[{"key":"k","label":"K"}%s],"rows":[{"k":@}]}'
_GRAPH = '"standard_data":{"artifact_type":"knowledge_graph","title":"g","nodes":[{"id":"a","label":"A","entity_type":"thing"}],"edges":[{"id":"e","source":"a","target":"%s","relation":"is"}]}'
_WIKI = '"standard_data":{"artifact_type":"wiki_markdown","title":"w","markdown":"# @"}'
_PEOPLE = '"standard_data":{"artifact_type":"entity_list","title":"p","entities":[{"id":"1","name":"N@","entity_type":"x"}]}'
#: answers by doc_id % 12; @ stands for the doc_id
ANSWERS = (
    _WRAP % (_ITEM % ("a1", "table", _TABLE % "")), _WRAP % '{"id":"a1","kind":"table","media_type":"application/json"}', _WRAP % (_ITEM % ("a1", "table", _TABLE % ',{"key":"k","label":"again"}')), _WRAP % (_ITEM % ("a1", "graph", _GRAPH % "missing")),
    _WRAP % ",".join((_ITEM % ("w1", "wiki", _WIKI), _ITEM % ("e1", "people", _PEOPLE))), '{"api_version": @', _WRAP % "", _WRAP % ",".join((_ITEM % ("w1", "wiki", _WIKI), _ITEM % ("w1", "people", _PEOPLE))),
    _WRAP % (_ITEM % ("a1", "x", '"text":"one","json_data":{"two":@}')), _WRAP % (_ITEM % ("a1", "x", '"text":"only @"')), (_WRAP % (_ITEM % ("a1", "wiki", _WIKI))).replace('"v1"', '"v2"'), _WRAP % (_ITEM % ("a1", "graph", _GRAPH % "a")),
)


def _answers(spark, sf_dir):
    body = F.replace(F.element_at(F.array(*[F.lit(a) for a in ANSWERS]), (F.col("doc_id") % 12 + 1).cast("int")), F.lit("@"), F.col("doc_id").cast("string"))
    rows = _docs(spark, sf_dir).select(F.col("doc_id").alias("request_id"), F.lit("object").alias("scope_type"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("scope_id"), F.lit("proc").alias("processor"), F.lit("2").alias("version"), F.lit("local").alias("url"), F.lit("2026-01-01 00:00:00").cast("timestamp").alias("written"), body.alias("body"))
    return contract.parsed(rows)


@query("""SELECT doc_id AS request_id, CASE WHEN doc_id % 12 IN (5, 6, 7, 10) THEN 0 ELSE 1 END AS place, CASE doc_id % 12 WHEN 1 THEN 'an artifact has exactly one payload' WHEN 2 THEN 'keys of columns repeat' WHEN 3 THEN 'an edge has no node' WHEN 5 THEN 'the body isn''t JSON' WHEN 6 THEN 'no artifacts'
 WHEN 7 THEN 'ids of artifacts repeat' WHEN 8 THEN 'an artifact has exactly one payload' WHEN 9 THEN 'an enrichment has standard data' ELSE 'another version of the contract' END AS problem FROM documents WHERE doc_id % 12 NOT IN (0, 4, 11)""")
def answer_problems(spark, sf_dir):
    return contract.response_problems(_answers(spark, sf_dir))


@query("""WITH a AS (SELECT doc_id, doc_id % 12 AS m, unnest(CASE WHEN doc_id % 12 = 4 THEN [1, 2] ELSE [1] END) AS p FROM documents WHERE doc_id % 12 IN (0, 4, 11)), n AS (SELECT *, CASE WHEN m = 4 AND p = 1 THEN 'w1' WHEN m = 4 THEN 'e1' ELSE 'a1' END AS id, CASE WHEN m = 0 THEN 'table' WHEN m = 11 THEN 'graph' WHEN p = 1 THEN 'wiki' ELSE 'people' END AS kind FROM a)
SELECT 'object' AS scope_type, 'doc-' || doc_id AS scope_id, kind, kind || '--proc' || CASE WHEN m = 4 THEN '.' || id ELSE '' END AS base, 'objects/doc-' || doc_id || '/enrichments/' || kind || '--proc' || CASE WHEN m = 4 THEN '.' || id ELSE '' END || '.json' AS data_path,
 '{"artifact_id":"' || id || '","method":"proc","version":"2","processor_url":"local"}' AS metadata,
 CASE WHEN m = 0 THEN '{"artifact_type":"table","columns":[{"key":"k","label":"K"}],"rows":[{"k":' || doc_id || '}],"title":"t"}' WHEN m = 11 THEN '{"artifact_type":"knowledge_graph","edges":[{"id":"e","relation":"is","source":"a","target":"a"}],"nodes":[{"entity_type":"thing","id":"a","label":"A"}],"title":"g"}'
 WHEN p = 1 THEN '{"artifact_type":"wiki_markdown","markdown":"# ' || doc_id || '","title":"w"}' ELSE '{"artifact_type":"entity_list","entities":[{"entity_type":"x","id":"1","name":"N' || doc_id || '"}],"title":"p"}' END AS payload FROM n""")
def answers_stored(spark, sf_dir):
    answers = _answers(spark, sf_dir)
    store = CorpusStore(spark, f"{shared_dir(spark)}/answers-{uuid.uuid4().hex}")
    store.put_artifacts(contract.stored_artifacts(answers, contract.response_problems(answers)))
    return store.artifacts().select("scope_type", "scope_id", "kind", "base", "data_path", "metadata", "payload")


# needles and questions ---------------------------------------------------------------------------

NEEDLES = "needles AS (SELECT item_id AS needle_id, text AS needle FROM benchmark UNION ALL SELECT item_id + 1000, upper(substr(text, 3, 9)) FROM benchmark UNION ALL SELECT item_id + 2000, ' ' || substr(text, 1, 2) || ' ' FROM benchmark WHERE item_id % 20 = 0)"


@query(rf"WITH {SEG}, {NEEDLES} SELECT needle_id, doc_id, 'seg-' || lpad(ord::VARCHAR, 6, '0') AS segment_id FROM needles JOIN seg ON contains(lower(seg.text), lower(trim(needle, E' \t\n\r\x0b\x0c')))")
def needles_in_segments(spark, sf_dir):
    path = f"{shared_dir(spark)}/grams-{uuid.uuid4().hex}"
    keys = ("doc_id", "segment_id")
    grams.write_grams(enrich.segments(_docs(spark, sf_dir), key="doc_id").select(*keys, "text"), path, keys)
    b = _t(spark, sf_dir, "benchmark")
    needles = b.select(F.col("item_id").alias("needle_id"), F.col("text").alias("needle")).unionByName(b.select((F.col("item_id") + 1000).alias("needle_id"), F.upper(F.substring("text", 3, 9)).alias("needle")))
    needles = needles.unionByName(b.where("item_id % 20 = 0").select((F.col("item_id") + 2000).alias("needle_id"), F.concat(F.lit(" "), F.left("text", F.lit(2)), F.lit(" ")).alias("needle")))
    return grams.find(spark, path, needles, keys=keys)


MANY = f"""{WIN}, tok AS (SELECT chunk_id, unnest(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_-]+'), lambda x: lower(x))) AS term FROM named),
dl AS (SELECT n.chunk_id, count(t.term) AS dl FROM named n LEFT JOIN tok t USING (chunk_id) GROUP BY 1), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
q AS (SELECT item_id AS question_id, term, count(*) AS w FROM (SELECT item_id, unnest(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_-]+'), lambda x: lower(x))) AS term FROM benchmark) GROUP BY 1, 2),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM tok WHERE term IN (SELECT term FROM q) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
many AS (SELECT question_id, chunk_id, sum(w * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score FROM tf JOIN df USING (term) JOIN q USING (term) JOIN dl USING (chunk_id), st GROUP BY 1, 2),
hit AS (SELECT question_id, chunk_id, score, source_relpath, starts_with(source_relpath, 'src1/de/') AS near FROM many JOIN named USING (chunk_id))"""


def _questions(spark, sf_dir):
    return _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), "text")


@query(f"WITH {MANY} SELECT question_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY question_id ORDER BY round(hit.score, 9) DESC, source_relpath, chunk_id)::INT AS rank FROM hit QUALIFY rank <= 5")
def many_questions(spark, sf_dir):
    return batch.search_many(_index(spark, sf_dir), _questions(spark, sf_dir), 5).select("question_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {MANY}, own AS (SELECT DISTINCT question_id FROM hit WHERE near) SELECT question_id, chunk_id, round(score, 6) AS score, CASE WHEN near AND question_id IN (SELECT question_id FROM own) THEN 'preferred' ELSE 'fallback' END AS used FROM hit WHERE near OR question_id NOT IN (SELECT question_id FROM own)
QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY round(hit.score, 9) DESC, source_relpath, chunk_id) <= 3""")
def questions_with_fallback(spark, sf_dir):
    found = batch.search_with_fallback(_index(spark, sf_dir), _questions(spark, sf_dir), Scope("folder", "src1/de"), Scope(), 3)
    return found.select("question_id", "chunk_id", F.round("score", 6).alias("score"), "used")


# manifests and records ---------------------------------------------------------------------------

MANIFESTS = f"""{FOLDERS}, ids AS (SELECT path, CASE WHEN contains(path, 'src1') THEN 'known-' || path ELSE 'folder-' || left(sha256(path), 12) END AS folder_id FROM allp),
d AS (SELECT source || '/' || lang AS path, file_id AS id, source_relpath AS item, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY lower('doc-' || doc_id || '.txt'), source_relpath, file_id) AS r FROM objects),
s AS (SELECT CASE WHEN contains(path, '/') THEN string_split(path, '/')[1] ELSE '' END AS path, folder_id AS id, path AS item, row_number() OVER (PARTITION BY CASE WHEN contains(path, '/') THEN string_split(path, '/')[1] ELSE '' END ORDER BY lower(string_split(path, '/')[-1]), path) AS r FROM ids WHERE path <> '')"""


def _dated(spark, sf_dir):
    o = _objects(spark, sf_dir)
    known = catalog.folder_tree(o).where(F.contains("path", F.lit("src1"))).select("path", F.concat(F.lit("known-"), F.col("path")).alias("folder_id"))
    return o.withColumn("mtime_utc", F.timestamp_seconds(F.col("doc_id") * 60)), known


@query(f"""WITH {MANIFESTS}, p AS (SELECT path, 'docs' AS part, id, item, r FROM d UNION ALL SELECT path, 'subfolders', id, item, r FROM s)
SELECT folder_id, path AS path_hint, part, (r - 1) // 20 AS page, string_agg(id || ' ' || item, ',' ORDER BY r) AS items FROM p JOIN ids USING (path) GROUP BY 1, 2, 3, 4""")
def folder_manifests(spark, sf_dir):
    found = manifests.folder_pages(*_dated(spark, sf_dir), 20)
    return found.withColumn("items", F.array_join(F.transform("items", lambda x: F.concat_ws(" ", x["id"], x["path"])), ","))


@query(f"""WITH {MANIFESTS}, f AS (SELECT path, strftime(make_timestamp(max(doc_id) * 60000000), '%Y-%m-%d %H:%M') AS latest, string_agg(id, ',' ORDER BY r) FILTER (r <= 3) AS first FROM d GROUP BY 1)
SELECT folder_id, path AS path_hint, coalesce(file_count, 0)::BIGINT AS file_count, coalesce(n, 0)::BIGINT AS subfolder_count, coalesce(total_bytes, 0)::BIGINT AS total_bytes, latest AS latest_mtime_utc, first AS recommended_file_ids FROM ids LEFT JOIN direct USING (path) LEFT JOIN kids USING (path) LEFT JOIN f USING (path)""")
def folder_figures(spark, sf_dir):
    found = manifests.folder_figures(*_dated(spark, sf_dir))
    return found.withColumn("latest_mtime_utc", F.date_format("latest_mtime_utc", "yyyy-MM-dd HH:mm")).withColumn("recommended_file_ids", F.array_join("recommended_file_ids", ","))


@query(r"""WITH a AS (SELECT doc_id, doc_id % 4 AS m, trim('It says: ' || text, E' \t\n\r\x0b\x0c') AS t FROM documents)
SELECT doc_id, CASE WHEN m < 2 THEN 'text ' || doc_id WHEN m = 2 THEN trim(left(t, 300), E' \t\n\r\x0b\x0c') END AS synthesis, CASE WHEN m = 0 THEN 'report' WHEN m = 1 THEN 'letter' WHEN m = 2 THEN 'unknown' END AS doc_type, CASE WHEN m < 2 THEN 'high' WHEN m = 2 THEN 'low' END AS quality, sha256(CASE WHEN m < 2 THEN 'about ' || doc_id WHEN m = 2 THEN t END) AS description, m = 2 AS fallback FROM a""")
def answer_records(spark, sf_dir):
    k = F.col("doc_id").cast("string")
    toml = lambda kind: F.concat(F.lit('[synthesis]\nsynthesis = "text '), k, F.lit(f'"\ndoc_type = "{kind}"\nquality = "high"\n[details]\ndescription = "about '), k, F.lit('"\n'))
    m = F.col("doc_id") % 4
    raw = F.when(m == 0, toml("report")).when(m == 1, F.concat(F.lit("```toml\n"), toml("letter"), F.lit("```"))).when(m == 2, F.concat(F.lit("It says: "), F.col("text")))
    return bundles.answers_as_records(_docs(spark, sf_dir).select("doc_id", raw.alias("raw")), "doc_id").withColumn("description", F.sha2("description", 256))
