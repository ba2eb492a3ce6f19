"""Queries over the corpus model, and the SQL that gives the same rows.

Each entry is registered by @query(sql); sql is None where SQL can't express it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import geometry, paths, text, vectors
from millrace.operators import catalog, chunking, enrich, jobs, lexical, overviews, scopes, vector
from millrace.plans import search as plans
from millrace.session import shared_dir
from millrace.sources import corpus
from millrace.streaming import publish

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from millrace import catalogue_answers, catalogue_artifacts, catalogue_records, catalogue_store  # noqa: F401  (they register their queries)

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents")


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.objects(_docs(spark, sf_dir))


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunks(_objects(spark, sf_dir).select("doc_id", "file_id", "source_relpath", "text"), "window", key="doc_id")


_BUILT: dict[tuple[str, str], plans.Index] = {}


def _index(spark: SparkSession, sf_dir: str) -> plans.Index:
    """The index of a corpus: built by the first query of a session that needs it, in the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        e = _t(spark, sf_dir, "embeddings")
        vecs = e.select(F.format_string("chunk-%s-000001", F.col("vec_id").cast("string")).alias("chunk_id"), "embedding")
        _BUILT[key] = plans.build(_windows(spark, sf_dir), f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", vecs)
    return _BUILT[key]


#: the SQL of the tables that queries start from
OBJ = "objects AS (SELECT doc_id, 'sha256-' || sha256(text) AS file_id, source || '/' || lang || '/doc-' || doc_id || '.txt' AS source_relpath, strlen(text) AS size_bytes, text, source, lang FROM documents)"
RAWWIN = """raww AS (SELECT doc_id, file_id, source_relpath, i, substr(text, i * 1000 + 1, 1200) AS w FROM (
  SELECT *, unnest(range(0, 1 + greatest(0, ceil((length(text) - 1200) / 1000.0))::BIGINT)) AS i FROM objects WHERE regexp_matches(text, '[^\\s]')))"""
WIN = f"""{OBJ}, {RAWWIN},
chunks AS (SELECT doc_id, file_id, source_relpath, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS chunk_index, i * 1000 + length(w) - length(ltrim(w, E' \\t\\n\\r\\x0b\\x0c')) AS char_start,
  trim(w, E' \\t\\n\\r\\x0b\\x0c') AS text FROM raww WHERE trim(w, E' \\t\\n\\r\\x0b\\x0c') <> ''),
named AS (SELECT *, 'chunk-' || doc_id || '-' || lpad(chunk_index::VARCHAR, 6, '0') AS chunk_id, char_start + length(text) AS char_end FROM chunks)"""
FOLDERS = f"""{OBJ}, par AS (SELECT doc_id, source, source || '/' || lang AS folder, size_bytes FROM objects),
allp AS (SELECT '' AS path UNION SELECT source FROM par UNION SELECT folder FROM par),
direct AS (SELECT folder AS path, count(*) AS file_count, sum(size_bytes) AS total_bytes FROM par GROUP BY 1),
kids AS (SELECT CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS path, count(*) AS n FROM allp WHERE path <> '' GROUP BY 1)"""
COLL = f"""{OBJ}, named_labels AS (SELECT doc_id, 'good' AS name FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1),
members AS (SELECT 'col-' || left(sha256(name), 12) AS collection_id, name, file_id, min(doc_id) AS created FROM named_labels JOIN objects USING (doc_id) GROUP BY 1, 2, 3)"""
#: the query of the search entries
ASKED = "Licensed under the Apache License, Version 2.0"


# content and paths ---------------------------------------------------------------------------


@query(f"WITH {OBJ} SELECT doc_id, file_id, source_relpath, size_bytes FROM objects")
def content_id(spark, sf_dir):
    return _objects(spark, sf_dir).drop("text")


@query(f"WITH {OBJ} SELECT file_id, min(source_relpath) AS source_relpath FROM objects GROUP BY 1")
def content_dedupe(spark, sf_dir):
    return corpus.first_by_content(_objects(spark, sf_dir)).select("file_id", "source_relpath")


@query(r"""SELECT doc_id, source || '/' || lang || '/d ' || doc_id || '.TXT' AS path, 'd ' || doc_id || '.TXT' AS name, '.txt' AS suffix, source || '/' || lang AS parent, 3::BIGINT AS depth, 'text/plain' AS mime,
 'd-' || doc_id || '.TXT' AS safe FROM documents""")
def path_parts(spark, sf_dir):
    raw = F.concat(F.lit(" /"), F.col("source"), F.lit("\\"), F.col("lang"), F.lit("/d "), F.col("doc_id").cast("string"), F.lit(".TXT/ "))
    d = _docs(spark, sf_dir).select("doc_id", paths.normalize(raw).alias("path"))
    p = F.col("path")
    return d.select("doc_id", "path", paths.basename(p).alias("name"), paths.suffix(p).alias("suffix"), paths.parent(p).alias("parent"), paths.depth(p).alias("depth"), paths.mime(p).alias("mime"), paths.safe_name(paths.basename(p)).alias("safe"))


@query("""SELECT doc_id, CASE WHEN n < 1024 THEN printf('%.1f B', n) WHEN n < 1048576 THEN printf('%.1f KB', n / 1024) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576) WHEN n < 1099511627776 THEN printf('%.1f GB', n / 1073741824) ELSE printf('%.1f TB', n / 1099511627776) END AS size
FROM (SELECT doc_id, strlen(text)::DOUBLE * pow(1024, doc_id % 5) AS n FROM documents)""")
def human_size(spark, sf_dir):
    n = F.col("size_bytes").cast("double") * F.pow(F.lit(1024.0), F.col("doc_id") % 5)
    return _objects(spark, sf_dir).select("doc_id", paths.human_size(n).alias("size"))


@query("SELECT '.txt' AS suffix, count(*) AS files FROM documents")
def suffix_stats(spark, sf_dir):
    s = paths.suffix(F.col("source_relpath"))
    return _objects(spark, sf_dir).groupBy(F.when(s == "", "<no_ext>").otherwise(s).alias("suffix")).agg(F.count(F.lit(1)).alias("files"))


@query("SELECT doc_id FROM documents WHERE (source LIKE 'src1%' AND lang = 'en') AND NOT contains('doc-' || doc_id || '.txt', '7')")
def glob_filter(spark, sf_dir):
    o = _objects(spark, sf_dir)
    p = F.col("source_relpath")
    return o.where(paths.matches_any(p, ["SRC1*/en/*"], True) & ~paths.matches_any(p, ["*doc-*7*.txt"], False)).select("doc_id")


@query("SELECT doc_id FROM documents WHERE source <> 'src3'")
def hidden_filter(spark, sf_dir):
    p = F.when(F.col("source_relpath").startswith("src3/"), F.concat(F.lit("."), F.col("source_relpath"))).otherwise(F.col("source_relpath"))
    return _objects(spark, sf_dir).where(~paths.hidden(p)).select("doc_id")


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'plain' WHEN 'de' THEN 'deep' ELSE 'tika' END AS by_suffix, CASE WHEN source LIKE 'src1%' THEN 'first' ELSE 'rest' END AS by_path FROM documents")
def extractor_route(spark, sf_dir):
    key = F.concat(F.lit("."), F.col("lang"))
    d = _docs(spark, sf_dir)
    return d.select("doc_id", paths.first_route(key, [([".EN"], "plain"), ([".de"], "deep"), (["*"], "tika")], "none").alias("by_suffix"), paths.first_glob_route(F.col("source"), [(["/src1*/"], "first"), (["*"], "rest")], "none").alias("by_path"))


@query("""WITH f AS (SELECT doc_id, '.' || lang AS suffix, CASE lang WHEN 'en' THEN 'native' WHEN 'es' THEN 'ocr' ELSE 'tika' END AS extractor, 'doc-' || doc_id || '.' || lang AS name FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY suffix, extractor ORDER BY doc_id) AS k FROM f)
SELECT suffix, extractor, count(*) AS files, string_agg(name, ',' ORDER BY doc_id) FILTER (k <= 3) AS examples FROM r GROUP BY 1, 2""")
def extractor_plan(spark, sf_dir):
    f = _docs(spark, sf_dir).select(F.col("doc_id").alias("ord"), F.concat(F.col("source"), F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang")).alias("source_relpath"))
    return catalog.extractor_plan(f, [([".en"], "native"), ([".fr", ".es"], "tika")], {".ES": "ocr"})


@query("""WITH r AS (SELECT doc_id, sum(strlen(text)) OVER (ORDER BY doc_id) AS running_bytes, count(*) OVER (ORDER BY doc_id) AS running_files FROM documents)
SELECT doc_id, running_bytes::BIGINT AS running_bytes, running_files FROM r WHERE running_bytes <= 500000 AND running_files <= 250""")
def intake_budget(spark, sf_dir):
    return catalog.within_budget(_objects(spark, sf_dir).select("doc_id", "size_bytes"), "doc_id", "size_bytes", 250, 500_000).select("doc_id", "running_bytes", "running_files")


@query("""SELECT count(*) AS files, count(l.doc_id) AS processed, count(*) - count(l.doc_id) AS unprocessed FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)""")
def processed_counts(spark, sf_dir):
    done = _t(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("done")).distinct()
    j = _docs(spark, sf_dir).select("doc_id").join(done, "doc_id", "left")
    return j.agg(F.count(F.lit(1)).alias("files"), F.count("done").alias("processed"), F.count_if(F.col("done").isNull()).alias("unprocessed"))


# texts ---------------------------------------------------------------------------------------


@query("""SELECT token, count(*) AS n FROM (SELECT unnest(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_-]+'), lambda x: lower(x))) AS token FROM documents) GROUP BY 1""")
def token_counts(spark, sf_dir):
    return _docs(spark, sf_dir).select(F.explode(text.search_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH t AS (SELECT doc_id, unnest(k) AS keyword, generate_subscripts(k, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z][a-z0-9_-][a-z0-9_-]+') AS k FROM documents))
SELECT keyword, count(*) AS count FROM t WHERE NOT contains(' the and for are with that this from into was were have has had but not you your their they them his her its our out all any can may will would should could about there which when what where while than then also such using used use these those within over under after before between because being been each other some more most only very onto upon report document ', ' ' || keyword || ' ') GROUP BY 1 ORDER BY 2 DESC, min(struct_pack(a := doc_id, b := pos)) LIMIT 20""")
def keywords_top_k(spark, sf_dir):
    return enrich.top_keywords(_docs(spark, sf_dir), 20)


@query(f"WITH {WIN} SELECT chunk_id, chunk_index, char_start, char_end, text FROM named")
def window_chunks(spark, sf_dir):
    return _windows(spark, sf_dir).select("chunk_id", "chunk_index", "char_start", "char_end", "text")


@query(r"""WITH c AS (SELECT conv_id, string_agg(text, E'\n\n' ORDER BY turn) AS text FROM conversations GROUP BY 1),
p AS (SELECT conv_id, unnest(k) AS text, generate_subscripts(k, 1) AS chunk_index FROM (SELECT conv_id, regexp_extract_all(text, '\S(?:.*?\S)?(?:\n\s*\n|\n?$)', 0, 's') AS k FROM c))
SELECT conv_id, chunk_index, trim(text, E' \t\n\r\x0b\x0c') AS text FROM p""")
def paragraph_chunks(spark, sf_dir):
    return chunking.chunks(corpus.conversation_texts(_t(spark, sf_dir, "conversations")), "paragraph", key="conv_id").select("conv_id", "chunk_index", "text")


@query("SELECT doc_id, substr(text, doc_id % 50 + 1, 30) AS part FROM documents WHERE doc_id % 50 <= length(text) UNION ALL SELECT doc_id, NULL FROM documents WHERE doc_id % 50 > length(text)")
def span_slice(spark, sf_dir):
    a = (F.col("doc_id") % 50).cast("bigint")
    return _docs(spark, sf_dir).select("doc_id", text.span(F.col("text"), a, a + 30).alias("part"))


@query("""SELECT doc_id, CASE WHEN length(text) >= 50 THEN substr(text, 51, 200) END AS before, CASE WHEN length(text) >= 250 THEN substr(text, 251, 50) END AS "match", CASE WHEN length(text) >= 300 THEN substr(text, 301, 200) END AS after, least(length(text), 500)::BIGINT AS window_end FROM documents""")
def span_context(spark, sf_dir):
    c = text.context(F.col("text"), F.lit(250).cast("bigint"), F.lit(300).cast("bigint"))
    return _docs(spark, sf_dir).select("doc_id", c.alias("c")).select("doc_id", "c.before", "c.match", "c.after", "c.window_end")


@query(r"SELECT doc_id, CASE WHEN length(text) > 0 THEN trim(left(text, 400), E' \t\n\r\x0b\x0c') END AS snippet, trim(left(text, 240), E' \t\n\r\x0b\x0c') AS preview FROM documents")
def snippet(spark, sf_dir):
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", text.snippet(t).alias("snippet"), text.preview(t).alias("preview"))


@query(r"""SELECT doc_id, CASE WHEN length(text) > 1024 THEN rtrim(left(text, 1024), E' \t\n\r\x0b\x0c') ELSE text END AS text, length(text) > 1024 AS truncated, greatest(1, ceil(length(text) / 4.0))::BIGINT AS tokens FROM documents""")
def embed_truncate(spark, sf_dir):
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", text.truncate(t, 1024).alias("text"), (F.length(t) > 1024).alias("truncated"), text.approx_tokens(F.length(t)).alias("tokens"))


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, '.', ' . '), '\r\n?', E'\n', 'g'), '\n{3,}', E'\n\n', 'g'), '[ \t]+', ' ', 'g'), ' *\n *', E'\n', 'g'), E' \t\n\r\x0b\x0c') AS text FROM documents""")
def light_clean(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.light_clean(F.replace("text", F.lit("."), F.lit(" . "))).alias("text"))


#: the lines of each text, and which are no prose
LINES = r"""raw AS (SELECT doc_id, text, string_split(replace(replace(text, E'\r\n', E'\n'), E'\r', E'\n'), E'\n') AS k FROM documents),
ln AS (SELECT doc_id, unnest(k) AS line, generate_subscripts(k, 1) AS i FROM raw),
st AS (SELECT doc_id, i, line, trim(line, E' \t\r\x0b\x0c  ') AS s FROM ln),
ms AS (SELECT *, length(s) AS n, length(regexp_replace(s, '[^\p{L}]', '', 'g')) AS a, length(regexp_replace(s, '[^aeiouAEIOU]', '', 'g')) AS v FROM st),
gl AS (SELECT doc_id, i, line, CASE WHEN n = 0 OR n > 600 OR a = 0 THEN true WHEN a / n::DOUBLE < 0.2 THEN NOT (length(s) - length(replace(s, ',', '')) >= 3 OR length(s) - length(replace(s, E'\t', '')) >= 3 OR regexp_matches(s, '(^|[^\p{L}\p{N}_])\p{Nd}+($|[^\p{L}\p{N}_])'))
  WHEN v / a::DOUBLE < 0.1 THEN true WHEN n >= 9 AND len(list_filter(range(1, n - 7), lambda j: substr(s, j, 9) = repeat(substr(s, j, 1), 9))) > 0 THEN true ELSE regexp_matches(s, '[\x00-\x08\x0b\x0c\x0e-\x1f]') END AS garbage FROM ms)"""


@query(f"WITH {LINES} SELECT doc_id, count(*) AS lines_total, count_if(NOT garbage) AS lines_kept FROM gl GROUP BY 1")
def garbage_lines(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.explode(text.raw_lines(F.col("text"))).alias("line"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines_total"), F.count_if(~text.garbage_line(F.col("line"))).alias("lines_kept"))


@query(rf"""WITH {LINES}, c AS (SELECT doc_id, count(*) AS lines_total, count_if(NOT garbage) AS lines_kept, coalesce(string_agg(trim(regexp_replace(line, '[ \t]{{2,}}', ' ', 'g'), E' \t\r\x0b\x0c  '), E'\n' ORDER BY i) FILTER (NOT garbage), '') AS t FROM gl GROUP BY 1),
z AS (SELECT *, trim(regexp_replace(t, '\n{{3,}}', E'\n\n', 'g'), E' \t\n\r\x0b\x0c  ') AS x FROM c)
SELECT z.doc_id, x AS text, length(d.text) AS original_chars, length(x) AS cleaned_chars, lines_total, lines_kept, lines_total - lines_kept AS lines_dropped, round((lines_total - lines_kept) / greatest(1, lines_total)::DOUBLE, 9) AS dropped_line_frac FROM z JOIN documents d USING (doc_id)""")
def cleaned_texts(spark, sf_dir):
    c = _docs(spark, sf_dir).select("doc_id", text.clean_with_counts(F.col("text")).alias("c")).select("doc_id", "c.*")
    return c.withColumn("dropped_line_frac", F.round("dropped_line_frac", 9)).withColumns({n: F.col(n).cast("bigint") for n in ("original_chars", "cleaned_chars", "lines_total", "lines_kept", "lines_dropped")})


@query(None)  # a greedy fold over each text
def recursive_split(spark, sf_dir):
    return enrich.recursive_parts(_docs(spark, sf_dir), 4000, 6000).select("doc_id", "part", F.length("text").alias("n_chars"))


@query(r"""SELECT 'entity-' || row_number() OVER (ORDER BY entity) AS entity_id, entity FROM (SELECT DISTINCT unnest(regexp_extract_all(regexp_replace(regexp_replace(text, '[^\x01-\x7f\p{L}\p{N}\p{M}]', '.', 'g'), '[^\x01-\x7f]', '_', 'g'), '\b[A-Z][A-Za-z]+(?: [A-Z][A-Za-z]+)*\b')) AS entity FROM documents)""")
def entity_list(spark, sf_dir):
    return enrich.capitalised_phrases(_docs(spark, sf_dir))


@query(r"""WITH l AS (SELECT doc_id, unnest(k) AS line, generate_subscripts(k, 1) AS line_number FROM (SELECT doc_id, string_split(text, E'\n') AS k FROM documents)),
c AS (SELECT doc_id, line_number, list_transform(string_split(line, '|'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))) AS cells FROM l)
SELECT doc_id, line_number, len(cells) AS n_cells, cells[1] AS first_cell FROM c WHERE len(cells) >= 2 AND len(list_filter(cells, lambda x: x = '')) = 0""")
def table_rows(spark, sf_dir):
    return enrich.table_rows(_docs(spark, sf_dir)).select("doc_id", "line_number", F.size("cells").cast("bigint").alias("n_cells"), F.get("cells", F.lit(0)).alias("first_cell"))


@query(None)  # tag soup: Spark's patterns have back-references
def html_extract(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", corpus.html_text(F.col("html")).alias("text"))


# segments, edits, summaries --------------------------------------------------------------------

SEG = r"""seg AS (SELECT doc_id, i + 1 AS ord, substr(t, i * 4000 + 1, 4000) AS text FROM (SELECT doc_id, t, unnest(range(0, ceil(length(t) / 4000.0)::BIGINT)) AS i FROM (SELECT doc_id, trim(text, E' \t\n\r\x0b\x0c') AS t FROM documents)))"""


@query(f"""WITH {SEG}, s AS (SELECT doc_id, ord, text, coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start FROM seg)
SELECT doc_id, 'seg-' || lpad(ord::VARCHAR, 6, '0') AS segment_id, char_start, char_start + length(text) AS char_end FROM s""")
def segment_spans(spark, sf_dir):
    return enrich.segments(_docs(spark, sf_dir), key="doc_id").select("doc_id", "segment_id", "char_start", "char_end")


@query(rf"""WITH {SEG}, e AS (SELECT doc_id, ord, CASE WHEN doc_id % 10 = 0 AND ord = 1 THEN 'edited ' || doc_id ELSE text END AS text FROM seg)
SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'edited' ELSE 'canonical' END AS representation,
 CASE WHEN doc_id % 10 = 0 THEN (SELECT trim(string_agg(e.text, E'\n\n' ORDER BY ord), E' \t\n\r\x0b\x0c') FROM e WHERE e.doc_id = d.doc_id) ELSE d.text END AS text FROM documents d""")
def preferred_text(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    edits = docs.where("doc_id % 10 = 0").select("doc_id", F.lit("seg-000001").alias("segment_id"), F.concat(F.lit("edited "), F.col("doc_id").cast("string")).alias("new_text"))
    edited = enrich.edited_texts(enrich.segments(docs.where("doc_id % 10 = 0"), key="doc_id"), edits, "doc_id")
    return enrich.preferred_texts(docs, edited, "doc_id")


def _light(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '\r\n?', E'\n', 'g'), '\n{{3,}}', E'\n\n', 'g'), '[ \t]+', ' ', 'g'), ' *\n *', E'\n', 'g'), E' \t\n\r\x0b\x0c')"


def _first(x: str, n: int) -> str:
    return rf"trim(left({_light(x)}, {n}), E' \t\n\r\x0b\x0c')"


@query(f"SELECT doc_id, {_first('text', 500)} AS text FROM documents")
def firstn_object(spark, sf_dir):
    return enrich.first_n(_docs(spark, sf_dir), 500).select("doc_id", "text")


def _folder_texts(spark, sf_dir, n: int) -> DataFrame:
    """The folder texts, deepest first: a document stands in its folder with its own synthesis or, without one, its text."""
    o = _objects(spark, sf_dir)
    known = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("synthesis of "), F.col("source_relpath"))).otherwise(F.col("text"))
    direct = o.select(paths.parent(F.col("source_relpath")).alias("path"), F.col("doc_id").alias("ord"), known.alias("text"))
    return enrich.bottom_up(catalog.folder_tree(o), direct, lambda parts: enrich.joined_first_n(parts, n))


FOLDER_TEXTS = f"""{OBJ}, leaf AS (SELECT source || '/' || lang AS path, {_first("string_agg(CASE WHEN doc_id % 4 = 0 THEN 'synthesis of ' || source_relpath ELSE text END, E'\n\n' ORDER BY doc_id)", 3000)} AS text FROM objects GROUP BY 1),
mid AS (SELECT string_split(path, '/')[1] AS path, {_first("string_agg(text, E'\n\n' ORDER BY path)", 3000)} AS text FROM leaf GROUP BY 1), top AS (SELECT '' AS path, {_first("string_agg(text, E'\n\n' ORDER BY path)", 3000)} AS text FROM mid),
folder_texts AS (SELECT * FROM leaf UNION ALL SELECT * FROM mid UNION ALL SELECT * FROM top)"""


@query(f"WITH {FOLDER_TEXTS} SELECT path, text FROM folder_texts")
def firstn_folder(spark, sf_dir):
    return _folder_texts(spark, sf_dir, 3000)


@query(f"WITH {FOLDER_TEXTS} SELECT 'root' AS scope_type, text FROM folder_texts WHERE path = ''")
def root_synthesis(spark, sf_dir):
    return _folder_texts(spark, sf_dir, 3000).where("path = ''").select(F.lit("root").alias("scope_type"), "text")


@query(None)  # rounds of folding; tests hold it against a plain fold
def folded_summary(spark, sf_dir):
    rows = _docs(spark, sf_dir).select(F.concat_ws("/", "source", "lang").alias("scope_id"), F.col("doc_id").alias("ord"), "text")
    # a stand-in for a model: what it writes is short and depends on all that it reads
    stand_in = lambda d: d.withColumn("text", F.concat(F.lit("summary "), F.left(F.sha2("text", 256), F.lit(16))))
    return enrich.folded(rows, 8, stand_in)


# search --------------------------------------------------------------------------------------

BM = f"""{WIN}, tok AS (SELECT chunk_id, unnest(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_-]+'), lambda x: lower(x))) AS term FROM named),
dl AS (SELECT n.chunk_id, count(t.term) AS dl FROM named n LEFT JOIN tok t USING (chunk_id) GROUP BY 1), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
q AS (SELECT term, count(*) AS w FROM (SELECT unnest(['licensed', 'under', 'the', 'apache', 'license', 'version']) AS term) GROUP BY 1),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM tok WHERE term IN (SELECT term FROM q) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
bm AS (SELECT chunk_id, sum(w * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score FROM tf JOIN df USING (term) JOIN q USING (term) JOIN dl USING (chunk_id), st GROUP BY 1),
lex AS (SELECT n.doc_id, file_id, source_relpath, chunk_id, text, score FROM bm JOIN named n USING (chunk_id))"""
VEC = """qv AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 7), sem AS (SELECT vec_id, list_sum(list_transform(list_zip(embedding, q), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) AS score FROM embeddings, qv)"""


@query(f"WITH {BM} SELECT (SELECT n FROM st) AS n_chunks, round((SELECT avgdl FROM st), 6) AS avgdl")
def bm25_stats(spark, sf_dir):
    return lexical.corpus_stats(_windows(spark, sf_dir)).select("n_chunks", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {BM} SELECT source_relpath, chunk_id, round(score, 6) AS score, trim(left(text, 400), E' \\t\\n\\r\\x0b\\x0c') AS snippet FROM lex ORDER BY round(lex.score, 9) DESC, source_relpath, chunk_id LIMIT 10")
def lexical_search(spark, sf_dir):
    return plans.search(_index(spark, sf_dir), ASKED).select("source_relpath", "chunk_id", F.round("score", 6).alias("score"), "snippet")


@query(f"WITH {BM} SELECT chunk_id, round(score, 6) AS score FROM lex ORDER BY round(lex.score, 9) DESC, chunk_id LIMIT 10")
def indexed_search(spark, sf_dir):
    found = _index(spark, sf_dir).scored(ASKED, 10).orderBy(F.desc(F.round("score", 9)), "chunk_id").limit(10)
    return found.select("chunk_id", F.round("score", 6).alias("score"))


@query(f"WITH {BM} SELECT source_relpath, chunk_id, round(score, 6) AS score FROM lex WHERE source_relpath LIKE 'src1/%' ORDER BY round(lex.score, 9) DESC, source_relpath, chunk_id LIMIT 10")
def search_in_folder(spark, sf_dir):
    return plans.search(_index(spark, sf_dir), ASKED, scope=scopes.Scope("folder", "src1")).select("source_relpath", "chunk_id", F.round("score", 6).alias("score"))


@query(f"WITH {BM}, m AS (SELECT DISTINCT sha256(d.text) AS h FROM labels l JOIN documents d USING (doc_id) WHERE toxic = 1) SELECT source_relpath, chunk_id, round(score, 6) AS score FROM lex WHERE file_id IN (SELECT 'sha256-' || h FROM m) ORDER BY round(lex.score, 9) DESC, source_relpath, chunk_id LIMIT 10")
def search_in_collection(spark, sf_dir):
    _, members = corpus.collections(_docs(spark, sf_dir), _t(spark, sf_dir, "labels"))
    toxic = members.where("name = 'toxic'").select(F.lit("toxic").alias("collection_id"), "file_id")
    return plans.search(_index(spark, sf_dir), ASKED, scope=scopes.Scope("collection", "toxic"), members=toxic).select("source_relpath", "chunk_id", F.round("score", 6).alias("score"))


@query(f"""WITH {BM}, top AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, source_relpath, chunk_id) AS r FROM lex QUALIFY r <= 30)
SELECT file_id, chunk_id, round(score, 6) AS score FROM top QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY r) = 1""")
def group_by_file(spark, sf_dir):
    return plans.search(_index(spark, sf_dir), ASKED, top_k=30, group_by="file").select("file_id", "chunk_id", F.round("score", 6).alias("score"))


@query(f"WITH {VEC} SELECT vec_id, round(score, 6) AS score FROM sem ORDER BY round(sem.score, 9) DESC, vec_id LIMIT 10")
def vector_search(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 7").first()["embedding"]
    return vector.nearest(e, q).select("vec_id", F.round("score", 6).alias("score"))


@query(f"""WITH {BM}, {VEC}, l AS (SELECT file_id, chunk_id, row_number() OVER (ORDER BY round(score, 9) DESC, source_relpath, chunk_id) AS rank FROM lex QUALIFY rank <= 20),
s AS (SELECT file_id, chunk_id, row_number() OVER (ORDER BY round(sem.score, 9) DESC, source_relpath, chunk_id) AS rank FROM named JOIN sem ON doc_id = vec_id AND chunk_index = 1 QUALIFY rank <= 20),
f AS (SELECT file_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT * FROM l UNION ALL SELECT * FROM s) GROUP BY 1, 2)
SELECT source_relpath, chunk_id, round(f.score, 6) AS score FROM f JOIN named USING (file_id, chunk_id) ORDER BY round(f.score, 9) DESC, source_relpath, chunk_id LIMIT 20""")
def hybrid_search(spark, sf_dir):
    q = _t(spark, sf_dir, "embeddings").where("vec_id = 7").first()["embedding"]
    return plans.search(_index(spark, sf_dir), ASKED, "hybrid", 20, query_vector=q).select("source_relpath", "chunk_id", F.round("score", 6).alias("score"))


@query(f"WITH {BM} SELECT source_relpath, chunk_id, round(score, 6) AS score, trim(left(text, 400), E' \\t\\n\\r\\x0b\\x0c') AS snippet FROM lex ORDER BY round(lex.score, 9) DESC, source_relpath, chunk_id LIMIT 10")
def scanned_search(spark, sf_dir):
    return plans.search(_windows(spark, sf_dir), ASKED).select("source_relpath", "chunk_id", F.round("score", 6).alias("score"), "snippet")


@query(f"""WITH {WIN}, {VEC} SELECT source_relpath, chunk_id, round(score, 6) AS score FROM named JOIN sem ON doc_id = vec_id AND chunk_index = 1 ORDER BY round(sem.score, 9) DESC, source_relpath, chunk_id LIMIT 10""")
def semantic_search(spark, sf_dir):
    q = _t(spark, sf_dir, "embeddings").where("vec_id = 7").first()["embedding"]
    return plans.search(_index(spark, sf_dir), ASKED, "semantic", query_vector=q).select("source_relpath", "chunk_id", F.round("score", 6).alias("score"))


@query(f"""WITH {BM}, top AS (SELECT * FROM lex ORDER BY round(lex.score, 9) DESC, source_relpath, chunk_id LIMIT 50)
SELECT source_relpath, chunk_id, round(score, 6) AS score FROM top WHERE source_relpath LIKE 'src1/%' ORDER BY round(top.score, 9) DESC, source_relpath, chunk_id LIMIT 10""")
def overfetched_search(spark, sf_dir):
    return plans.search(_index(spark, sf_dir), ASKED, scope=scopes.Scope("folder", "src1"), overfetch=5).select("source_relpath", "chunk_id", F.round("score", 6).alias("score"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS total FROM embeddings")
def l2_normalize(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings")
    unit = vector.unit_vectors(e)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)
    return e.select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm")).join(unit.select("vec_id", F.round(total, 5).alias("total")), "vec_id")


@query("SELECT count(*) AS problems FROM (SELECT vec_id FROM embeddings WHERE len(embedding) <> 64 UNION ALL SELECT vec_id FROM embeddings GROUP BY 1 HAVING count(*) > 1)")
def vector_integrity(spark, sf_dir):
    return vector.bad_vectors(_t(spark, sf_dir, "embeddings"), 64).agg(F.count(F.lit(1)).alias("problems"))


@query("""SELECT doc_id, round((('0x' || substr(sha256(text), 1, 2))::INT - 127.5) / sqrt(list_sum(list_transform(range(0, 8), lambda i: pow((('0x' || substr(sha256(text), (2 * i + 1)::INT, 2))::INT - 127.5), 2)))), 6)::DOUBLE AS x0 FROM documents""")
def toy_embedder(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.round(F.get(vectors.toy_embedding(F.col("text")), F.lit(0)), 6).alias("x0"))


@query(f"""WITH {BM}, top AS (SELECT trim(left(text, 400), E' \\t\\n\\r\\x0b\\x0c') AS s, string_split(source_relpath, '/')[-1] AS f, row_number() OVER (ORDER BY round(score, 9) DESC, source_relpath, chunk_id) AS r FROM lex QUALIFY r <= 10)
SELECT E'The locally available evidence most relevant to your question is:\\n\\n' || string_agg('- ' || s || ' [' || f || ']', E'\\n' ORDER BY r) || E'\\n\\nThis answer uses the offline extractive fallback; verify the cited passages for interpretation.' AS answer FROM (SELECT * FROM top WHERE s <> '' ORDER BY r LIMIT 5)""")
def extractive_answer(spark, sf_dir):
    hits = plans.ranked(plans.search(_index(spark, sf_dir), ASKED), "source_relpath", "chunk_id")
    return enrich.extractive_answer(hits)


# scopes, folders, collections ------------------------------------------------------------------


@query(f"""WITH {OBJ} SELECT 'root' AS scope, count(*) AS n_members, sum(length(text))::BIGINT AS total_chars FROM objects UNION ALL SELECT 'folder', count(*), sum(length(text))::BIGINT FROM objects WHERE source_relpath LIKE 'src1/%'
UNION ALL SELECT 'object', count(*), sum(length(text))::BIGINT FROM objects WHERE file_id = (SELECT file_id FROM objects WHERE doc_id = 5) UNION ALL SELECT 'unknown', 0, 0""")
def scope_texts(spark, sf_dir):
    o = _objects(spark, sf_dir)
    one = o.where("doc_id = 5").first()["file_id"]
    out = None
    for name, s in (("root", scopes.Scope()), ("folder", scopes.Scope("folder", "src1")), ("object", scopes.Scope("document", one)), ("unknown", scopes.Scope("folder", "no/such"))):
        row = scopes.scope_texts(o, s).select(F.lit(name).alias("scope"), "n_members", "total_chars")
        out = row if out is None else out.unionByName(row)
    return out


@query(f"""WITH {FOLDERS} SELECT a.path, CASE WHEN a.path = '' THEN NULL WHEN contains(a.path, '/') THEN regexp_replace(a.path, '/[^/]*$', '') ELSE '' END AS parent_path, CASE WHEN a.path = '' THEN 0 ELSE len(string_split(a.path, '/')) END::BIGINT AS depth,
coalesce(file_count, 0)::BIGINT AS file_count, coalesce(n, 0)::BIGINT AS subfolder_count, coalesce(total_bytes, 0)::BIGINT AS total_bytes FROM allp a LEFT JOIN direct USING (path) LEFT JOIN kids USING (path)""")
def folder_tree(spark, sf_dir):
    return catalog.folder_tree(_objects(spark, sf_dir))


@query(f"""WITH {FOLDERS} SELECT path, 0 AS position, '' AS crumb FROM allp UNION ALL SELECT path, i::INT, array_to_string(string_split(path, '/')[1:i], '/') FROM (SELECT path, unnest(range(1, len(string_split(path, '/')) + 1)) AS i FROM allp WHERE path <> '')""")
def breadcrumbs(spark, sf_dir):
    return catalog.breadcrumbs(catalog.folder_tree(_objects(spark, sf_dir)))


@query(f"""WITH {FOLDERS} SELECT a.path, CASE WHEN a.path = '' THEN 'corpus' ELSE string_split(a.path, '/')[-1] END || ' contains ' || coalesce(file_count, 0) || CASE WHEN coalesce(file_count, 0) = 1 THEN ' direct document' ELSE ' direct documents' END
|| ' and ' || coalesce(n, 0) || CASE WHEN coalesce(n, 0) = 1 THEN ' direct subfolder.' ELSE ' direct subfolders.' END AS sentence FROM allp a LEFT JOIN direct USING (path) LEFT JOIN kids USING (path)""")
def inventory_sentence(spark, sf_dir):
    return enrich.inventory_sentence(catalog.folder_tree(_objects(spark, sf_dir)), "corpus")


@query(f"""WITH {OBJ}, fold AS (SELECT file_id, source_relpath FROM objects WHERE doc_id % 5 < 2), fin AS (SELECT CASE WHEN doc_id % 10 = 0 THEN file_id || 'x' ELSE file_id END AS file_id, source_relpath FROM objects WHERE doc_id % 3 <> 2),
a AS (SELECT file_id, min(source_relpath) AS source_relpath FROM fold GROUP BY 1) SELECT * FROM a UNION ALL SELECT file_id, min(source_relpath) FROM fin WHERE file_id NOT IN (SELECT file_id FROM a) AND source_relpath NOT IN (SELECT source_relpath FROM a) GROUP BY 1""")
def files_catalog(spark, sf_dir):
    o = _objects(spark, sf_dir)
    status = F.when(F.col("doc_id") % 3 == 2, "running").when(F.col("doc_id") % 3 == 1, "partial").otherwise("done")
    finished = o.select(F.when(F.col("doc_id") % 10 == 0, F.concat("file_id", F.lit("x"))).otherwise(F.col("file_id")).alias("file_id"), "source_relpath", status.alias("status"))
    return catalog.files_catalog(o.where("doc_id % 5 < 2"), finished)


@query(f"WITH {COLL} SELECT collection_id, name, count(*) AS document_count FROM members GROUP BY 1, 2")
def collection_counts(spark, sf_dir):
    return catalog.member_counts(*corpus.collections(_docs(spark, sf_dir), _t(spark, sf_dir, "labels")))


@query(f"WITH {COLL} SELECT file_id, string_agg(name, ',' ORDER BY lower(name)) AS collections FROM (SELECT DISTINCT file_id, name FROM members) GROUP BY 1")
def collections_for_file(spark, sf_dir):
    return catalog.collections_of_files(corpus.collections(_docs(spark, sf_dir), _t(spark, sf_dir, "labels"))[1])


@query(f"WITH {COLL}, r AS (SELECT DISTINCT file_id FROM objects) SELECT r.file_id, m.file_id IS NULL AS added FROM r LEFT JOIN (SELECT file_id FROM members WHERE name = 'good') m USING (file_id)")
def collection_add_diff(spark, sf_dir):
    members = corpus.collections(_docs(spark, sf_dir), _t(spark, sf_dir, "labels"))[1].where("name = 'good'").select(F.lit("c").alias("collection_id"), "file_id")
    asked = _objects(spark, sf_dir).select(F.lit("c").alias("collection_id"), "file_id")
    return catalog.add_members(members, asked).select("file_id", "added")


@query(f"""WITH {OBJ}, d AS (SELECT doc_id AS ord, CASE WHEN doc_id % 2 = 0 THEN file_id END AS f, CASE WHEN doc_id % 2 = 1 AND doc_id % 5 > 0 THEN source_relpath END AS p FROM objects),
x AS (SELECT ord, coalesce(f, o.file_id) AS file_id FROM d LEFT JOIN objects o ON o.source_relpath = d.p) SELECT min(ord) AS ord, file_id FROM x WHERE file_id IS NOT NULL GROUP BY 2 UNION ALL SELECT ord, NULL FROM x WHERE file_id IS NULL""")
def collection_resolve(spark, sf_dir):
    o = _objects(spark, sf_dir)
    even = F.col("doc_id") % 2 == 0
    path = F.when(F.col("doc_id") % 5 > 0, F.upper("source_relpath")).otherwise(F.lit("no/such.txt"))
    d = o.select(F.col("doc_id").alias("ord"), F.when(even, F.col("file_id")).alias("file_id"), F.when(~even, path).alias("source_relpath"))
    return catalog.resolve_members(d, o)


SIDES = f"""{OBJ}, src AS (SELECT CASE WHEN doc_id % 11 = 0 THEN 'moved/' || source_relpath ELSE source_relpath END AS source_relpath, CASE WHEN doc_id % 13 = 0 THEN file_id || 'x' ELSE file_id END AS file_id FROM objects WHERE doc_id % 7 <> 0
UNION ALL SELECT 'new/' || item_id || '.txt', 'sha256-' || sha256(text) FROM benchmark)"""
RECON = f"""WITH {SIDES}, spot AS (SELECT file_id, max(source_relpath) AS moved_to FROM src GROUP BY 1),
c AS (SELECT o.source_relpath, o.file_id, s.file_id AS now, spot.moved_to FROM objects o LEFT JOIN src s USING (source_relpath) LEFT JOIN spot ON spot.file_id = o.file_id),
olds AS (SELECT source_relpath, file_id, CASE WHEN now = file_id THEN 'unchanged' WHEN now IS NOT NULL THEN 'changed' WHEN moved_to IS NOT NULL THEN 'moved' ELSE 'missing' END AS state, CASE WHEN now IS NULL THEN moved_to END AS moved_to, CASE WHEN now <> file_id THEN now END AS new_file_id FROM c),
allr AS (SELECT * FROM olds UNION ALL SELECT source_relpath, file_id, 'new', NULL, NULL FROM src WHERE source_relpath NOT IN (SELECT source_relpath FROM objects) AND file_id NOT IN (SELECT file_id FROM olds WHERE state = 'moved'))"""


def _reconciled(spark, sf_dir):
    o = _objects(spark, sf_dir)
    moved = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("moved/"), F.col("source_relpath"))).otherwise(F.col("source_relpath"))
    changed = F.when(F.col("doc_id") % 13 == 0, F.concat(F.col("file_id"), F.lit("x"))).otherwise(F.col("file_id"))
    new = _t(spark, sf_dir, "benchmark").select(F.concat(F.lit("new/"), F.col("item_id").cast("string"), F.lit(".txt")).alias("source_relpath"), corpus.file_id(F.col("text")).alias("file_id"))
    source = o.where("doc_id % 7 <> 0").select(moved.alias("source_relpath"), changed.alias("file_id")).unionByName(new)
    return catalog.reconcile(o, source)


@query(f"{RECON} SELECT source_relpath, file_id, state, moved_to, new_file_id FROM allr")
def reconcile_classes(spark, sf_dir):
    return _reconciled(spark, sf_dir)


@query(f"{RECON} SELECT state, count(*) AS n FROM allr GROUP BY 1")
def reconcile_summary(spark, sf_dir):
    return _reconciled(spark, sf_dir).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


# artifacts, geometry, jobs ---------------------------------------------------------------------


@query("""SELECT o_orderkey AS edge_id, c_name AS source_label, coalesce(n_name, (o_custkey % 40)::VARCHAR) AS target_label FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = o_custkey % 40""")
def kg_edge_labels(spark, sf_dir):
    c, n = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "nation")
    nodes = c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node_id"), F.col("c_name").alias("label")).unionByName(n.select(F.col("n_nationkey").cast("string").alias("node_id"), F.col("n_name").alias("label")))
    edges = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("edge_id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source"), (F.col("o_custkey") % 40).cast("string").alias("target"))
    return enrich.labelled_edges(nodes, edges)


@query("""SELECT 'unknown node' AS problem, k::VARCHAR AS id FROM (SELECT DISTINCT o_custkey % 40 AS k FROM orders) WHERE k NOT IN (SELECT n_nationkey FROM nation)""")
def kg_integrity(spark, sf_dir):
    nodes = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("node_id"))
    k = (F.col("o_custkey") % 40).cast("bigint")
    return enrich.graph_problems(nodes, _t(spark, sf_dir, "orders").select(k.alias("source"), k.alias("target")))


@query("""WITH e AS (SELECT event_id, event_id % 400 AS a, event_id % 97 * 3 AS b, event_id % 400 + user_id % 90 AS c, event_id % 97 * 3 + event_id % 31 AS d FROM events)
SELECT event_id, greatest(0, a - 5) AS x1, greatest(0, b - 5) AS y1, least(500, c + 5) AS x2, least(320, d + 5) AS y2, round(a / 500::DOUBLE, 6) AS rx1, round(b / 320::DOUBLE, 6) AS ry1, round(c / 500::DOUBLE, 6) AS rx2, round(d / 320::DOUBLE, 6) AS ry2 FROM e""")
def bbox_normalize(spark, sf_dir):
    k = F.col("event_id")
    e = _t(spark, sf_dir, "events").select(k, F.struct((k % 400).alias("x1"), (k % 97 * 3).alias("y1"), (k % 400 + F.col("user_id") % 90).alias("x2"), (k % 97 * 3 + k % 31).alias("y2")).alias("b"))
    w, h = F.lit(500), F.lit(320)
    shares = geometry.relative_box(F.col("b"), w, h)
    return e.select("event_id", geometry.padded_box(F.col("b"), 5, w, h).alias("p"), shares.alias("r")).select("event_id", "p.*", *[F.round(f"r.{c}", 6).alias(f"r{c}") for c in ("x1", "y1", "x2", "y2")])


@query("""WITH e AS (SELECT event_id, [event_id % 91, user_id % 77] AS p, [event_id % 53, event_id % 37] AS q, [user_id % 31, event_id % 83] AS r, [event_id % 71, user_id % 67] AS s FROM events),
u AS (SELECT event_id, unnest([p, q, r, s]) AS p, generate_subscripts([p, q, r, s], 1) AS i FROM e)
SELECT event_id, arg_min(p[1], struct_pack(k := p[1] + p[2], i := i)) AS tlx, arg_min(p[1], struct_pack(k := p[2] - p[1], i := i)) AS trx, arg_max(p[1], struct_pack(k := p[1] + p[2], i := -i)) AS brx, arg_max(p[1], struct_pack(k := p[2] - p[1], i := -i)) AS blx,
 arg_min(p[2], struct_pack(k := p[1] + p[2], i := i)) AS tly FROM u GROUP BY 1""")
def corner_order(spark, sf_dir):
    k, u = F.col("event_id"), F.col("user_id")
    points = F.array(F.array(k % 91, u % 77), F.array(k % 53, k % 37), F.array(u % 31, k % 83), F.array(k % 71, u % 67))
    o = F.col("o")
    return _t(spark, sf_dir, "events").select(k, geometry.ordered_points(points).alias("o")).select(k, o[0][0].alias("tlx"), o[1][0].alias("trx"), o[2][0].alias("brx"), o[3][0].alias("blx"), o[0][1].alias("tly"))


@query("""SELECT user_id, event_id, rn FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 100 // 10, event_id % 7, event_id) AS rn FROM events) WHERE rn <= 200""")
def reading_order(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(F.floor(F.col("event_id") % 100 / 10), F.col("event_id") % 7, "event_id")
    return _t(spark, sf_dir, "events").withColumn("rn", F.row_number().over(w).cast("bigint")).where("rn <= 200").select("user_id", "event_id", "rn")


@query("SELECT event_type, round(coalesce(greatest(0, least(1, avg(value) / 100)), 1.0), 6)::DOUBLE AS confidence FROM events GROUP BY 1")
def ocr_confidence(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.avg("value") / 100)), F.lit(1.0)), 6).alias("confidence"))


def _jobs(spark, sf_dir):
    status = F.element_at(F.array(*[F.lit(s) for s in ("queued", "running", "done")]), (F.col("event_id") % 3 + 1).cast("int"))
    return _t(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), status.alias("status"))


@query("SELECT event_id AS id FROM events WHERE event_id % 3 = 0 ORDER BY ts, event_id LIMIT 1")
def queue_next_job(spark, sf_dir):
    return jobs.next_job(_jobs(spark, sf_dir)).select("id")


@query("SELECT event_id AS id FROM events ORDER BY ts DESC, event_id DESC LIMIT 25")
def latest_runs(spark, sf_dir):
    return jobs.latest_runs(_jobs(spark, sf_dir), 25).select("id")


@query("SELECT CASE event_id % 3 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' ELSE 'done' END AS status, count(*) AS n FROM events GROUP BY 1")
def run_counts(spark, sf_dir):
    return jobs.status_counts(_jobs(spark, sf_dir))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    return publish.windowed_counts(_t(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("""SELECT user_id, max_by(event_type, struct_pack(a := ts, b := event_id)) AS event_type, max_by(event_id, struct_pack(a := ts, b := event_id)) AS event_id FROM events GROUP BY 1""")
def upsert_latest(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("at"), "event_id", "event_type")
    return catalog.latest(e, "user_id", "at").select("user_id", "event_type", "event_id")


@query(f"WITH {OBJ}, done AS (SELECT DISTINCT doc_id FROM labels) SELECT doc_id FROM objects WHERE doc_id NOT IN (SELECT doc_id FROM done)")
def resume_left(spark, sf_dir):
    return publish.new_only(_objects(spark, sf_dir).select("doc_id"), _t(spark, sf_dir, "labels"), "doc_id")


# overviews -------------------------------------------------------------------------------------

COLLS = "(SELECT file_id, string_agg(name, ',' ORDER BY lower(name)) AS collections FROM (SELECT DISTINCT file_id, name FROM members) GROUP BY 1)"


@query(rf"""WITH {COLL}, {SEG}, n AS (SELECT doc_id, count(*) AS n FROM seg GROUP BY 1) SELECT o.doc_id, o.file_id, 'text/plain' AS mime, CASE WHEN length(text) > 0 THEN trim(left(text, 240), E' \t\n\r\x0b\x0c') END AS preview, coalesce(n, 0) AS n_segments, coalesce(collections, '') AS collections
FROM objects o LEFT JOIN n USING (doc_id) LEFT JOIN {COLLS} c ON c.file_id = o.file_id""")
def object_summaries(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return overviews.object_summaries(corpus.objects(docs), corpus.collections(docs, _t(spark, sf_dir, "labels"))[1], enrich.segments(docs, key="doc_id"))


FOLDED = "source || '/' || lang"


@query(f"""WITH {FOLDER_TEXTS} SELECT source || '/' || lang AS path, 'document' AS part, 'doc-' || doc_id || '.txt' AS name, {_first('text', 500)} AS synthesis, CASE WHEN doc_id % 2 = 0 THEN 'report' ELSE 'unknown' END AS doc_type, 'default' AS quality FROM objects WHERE doc_id % 3 < 2
UNION ALL SELECT CASE WHEN contains(path, '/') THEN string_split(path, '/')[1] ELSE '' END, 'folder', path, text, 'folder', 'default' FROM folder_texts WHERE path <> ''""")
def folder_overview(spark, sf_dir):
    o = _objects(spark, sf_dir)
    made = enrich.first_n(o.where("doc_id % 3 < 2"), 500).select("doc_id", F.col("text").alias("synthesis"), F.when(F.col("doc_id") % 2 == 0, "report").alias("doc_type"), F.lit(None).cast("string").alias("quality"))
    return overviews.folder_overview(o, made, catalog.folder_tree(o), _folder_texts(spark, sf_dir, 3000).withColumnRenamed("text", "synthesis"))


@query(f"WITH {FOLDER_TEXTS} SELECT path, text AS synthesis, 'folder' AS kind, 'default' AS quality, (SELECT count(*) FROM folder_texts) AS folder_count FROM folder_texts WHERE path <> '' AND NOT contains(path, '/') AND path <> 'src4'")
def root_overview(spark, sf_dir):
    made = _folder_texts(spark, sf_dir, 3000).where("path <> 'src4'").withColumnRenamed("text", "synthesis")
    return overviews.root_overview(catalog.folder_tree(_objects(spark, sf_dir)), made)


@query(f"""WITH {COLL}, r AS (SELECT collection_id, file_id, row_number() OVER (PARTITION BY collection_id ORDER BY created, file_id) AS k, count(*) OVER (PARTITION BY collection_id) AS n FROM members)
SELECT collection_id AS scope_id, (k - 1) // 100 AS page, CASE WHEN (k - 1) // 100 = 0 THEN E'# Corpus Wiki\n\nThis local baseline describes a **collection** scope containing **' || any_value(n) || E'** objects.\n\n## Members\n\n' ELSE '' END || string_agg('- `' || file_id || '`', E'\n' ORDER BY k) || E'\n' AS markdown FROM r GROUP BY 1, 2""")
def wiki_members(spark, sf_dir):
    members = corpus.collections(_docs(spark, sf_dir), _t(spark, sf_dir, "labels"))[1]
    return overviews.wiki_pages(members.withColumnRenamed("collection_id", "scope_id"), "Corpus Wiki", per_page=100)


@query(f"""WITH {FOLDERS} SELECT 'root' AS scope_type, 'root' AS scope_id, 'root' AS label UNION ALL SELECT 'folder', path, CASE WHEN path = '' THEN 'root-folder' ELSE path END FROM allp
UNION ALL SELECT 'collection', 'col-' || left(sha256(n), 12), n FROM (VALUES ('good'), ('toxic')) v(n) WHERE (n = 'good' AND EXISTS (SELECT 1 FROM labels WHERE quality = 1)) OR (n = 'toxic' AND EXISTS (SELECT 1 FROM labels WHERE toxic = 1))""")
def scope_descriptions(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return overviews.described_scopes(catalog.folder_tree(corpus.objects(docs)), corpus.collections(docs, _t(spark, sf_dir, "labels"))[0])


@query(f"WITH {OBJ}, f AS (SELECT file_id, min(source_relpath) AS source_relpath, min(doc_id) AS d FROM objects GROUP BY 1) SELECT file_id, CASE WHEN d % 5 = 0 THEN 'missing_source' ELSE 'active' END AS status, CASE WHEN d % 10 = 0 THEN 'moved/' || d ELSE source_relpath END AS source_relpath FROM f")
def source_states(spark, sf_dir):
    f = _objects(spark, sf_dir).groupBy("file_id").agg(F.min("source_relpath").alias("source_relpath"), F.min("doc_id").alias("d"))
    states = f.where("d % 5 = 0").select("file_id", F.lit("missing_source").alias("status"), F.when(F.col("d") % 10 == 0, F.concat(F.lit("moved/"), F.col("d").cast("string"))).otherwise("").alias("source_relpath"))
    return overviews.source_states(f, states)


@query("SELECT doc_id, 'too long' AS problem FROM documents WHERE length(text) > 4000")
def embed_limits(spark, sf_dir):
    return overviews.unusable_inputs(_docs(spark, sf_dir), 4000)


@query(rf"""WITH {SEG}, s AS (SELECT doc_id, ord, text, coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a FROM seg),
q AS (SELECT doc_id, (doc_id % 5) * 1500 AS x, (doc_id % 5) * 1500 + 600 AS y FROM documents)
SELECT doc_id, x AS char_start, y AS char_end, 'seg-' || lpad(arg_min(ord, struct_pack(k := CASE WHEN a <= x AND a + length(text) >= y THEN 0 ELSE 1 END, o := ord))::VARCHAR, 6, '0') AS segment_id FROM q JOIN s USING (doc_id) WHERE a < y AND a + length(text) > x GROUP BY 1, 2, 3""")
def best_segment(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    at = F.col("doc_id") % 5 * 1500
    return enrich.best_segment(docs.select("doc_id", at.alias("char_start"), (at + 600).alias("char_end")), enrich.segments(docs, key="doc_id"), "doc_id")


@query(f"WITH {WIN} SELECT chunk_id, CASE WHEN length(text) > 1024 THEN rtrim(left(text, 1024), E' \\t\\n\\r\\x0b\\x0c') ELSE text END AS text, length(text) > 1024 AS truncated FROM named")
def embed_inputs(spark, sf_dir):
    t = F.col("text")
    return _windows(spark, sf_dir).select("chunk_id", text.truncate(t, 1024).alias("text"), (F.length(t) > 1024).alias("truncated"))


@query("SELECT 'path' AS what, count(*) AS n FROM (SELECT 1 FROM documents GROUP BY source, lang HAVING count(*) > 1)")
def folder_duplicates(spark, sf_dir):
    rows = _docs(spark, sf_dir).select(F.concat_ws("/", "source", "lang").alias("path"), F.col("doc_id").cast("string").alias("folder_id"))
    return catalog.duplicate_folders(rows).agg(F.lit("path").alias("what"), F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, least(a, b, c) AS x1, least(b, c, a + c) AS y1, greatest(a, b, c) AS x2, greatest(b, c, a + c) AS y2, CASE WHEN b * 2 <= 40 AND a * 4 / greatest(b * 2, 1)::DOUBLE >= 4 THEN 7 WHEN a * 4 <= 120 AND b * 2 <= 80 THEN 8 WHEN a * 4 / greatest(b * 2, 1)::DOUBLE >= 2.5 AND b * 2 <= 80 THEN 7 ELSE 6 END AS psm FROM (SELECT event_id, event_id % 91 AS a, user_id % 77 AS b, event_id % 53 AS c FROM events)")
def region_shapes(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 91).alias("a"), (F.col("user_id") % 77).alias("b"), (F.col("event_id") % 53).alias("c"))
    points = F.array(F.array("a", "b"), F.array("b", "c"), F.array("c", F.col("a") + F.col("c")))
    return e.select("event_id", geometry.polygon_box(points).alias("p"), geometry.segmentation_mode(F.col("a") * 4, F.col("b") * 2).alias("psm")).select("event_id", "p.*", "psm")


@query(f"""WITH {BM}, top AS (SELECT chunk_id, doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, source_relpath, chunk_id) AS r FROM lex QUALIFY r <= 10)
SELECT t.chunk_id, CASE WHEN r % 2 = 0 THEN substr(d.text, n.char_start + 1, n.char_end - n.char_start) ELSE 'given' END AS evidence FROM top t JOIN named n USING (chunk_id) JOIN documents d ON d.doc_id = t.doc_id""")
def evidence_backfill(spark, sf_dir):
    hits = plans.ranked(plans.search(_index(spark, sf_dir), ASKED), "source_relpath", "chunk_id")
    given = F.when(F.col("rank") % 2 == 1, "given")
    full = _docs(spark, sf_dir).select("doc_id", F.col("text").alias("whole"))
    # hits are few: they are sent to the documents, whose texts stay where they are
    few = F.broadcast(hits.select("doc_id", "chunk_id", "char_start", "char_end", given.alias("given")))
    return full.join(few, "doc_id").select("chunk_id", F.coalesce("given", text.span(F.col("whole"), F.col("char_start"), F.col("char_end"))).alias("evidence"))
