"""The registered queries of this subpackage, thin over its operators, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.fingerprints import fingerprints
from millrace.llm.kneser_ney import quality
from millrace.llm.mixing import mix_sources
from millrace.llm.ngram_join import ngram_components
from millrace.llm.packing import pack
from millrace.llm.pii import personal_data
from millrace.llm.rules import quality_rules
from millrace.llm.runs import periodic_runs, with_looped_tails
from millrace.llm.simhash import near_copies
from millrace.llm.substring import remove_repeats
from millrace.llm.token_files import read_token_files, write_token_files
from millrace.llm.toxicity import fit_scorer, toxicity
from millrace.llm.whitening import whiten
from millrace.session import shared_dir, table


def vocabulary() -> str:
    """The byte-level vocabulary of the queries; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity(docs, fit_scorer(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("offending").alias("n_offending"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"), n=4, percent=85)


def op5_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality(table(spark, sf_dir, "documents"), trusted)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), path, vocabulary(), end_id=2)
    return read_token_files(spark, path, with_ids=False)


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"), redacted=False)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), window=35, text_out=False)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary(), end_id=0, window=1024)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten(table(spark, sf_dir, "embeddings"), most=8)
    # beyond a long there is no exact deviation to return as one
    return found.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_looped_tails(table(spark, sf_dir, "documents")), least=6, times=4, whole=False)
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"), words=3, radius=2, seed=42)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP4 = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(w) < 4 THEN w ELSE w[i:i + 3] END, ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * ((SELECT n FROM n WHERE n.doc_id = a.doc_id) + (SELECT n FROM n WHERE n.doc_id = b.doc_id) - count(*))),
reach AS (SELECT a AS doc_id, a AS r FROM links UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce((SELECT min(r) FROM reach WHERE reach.doc_id = d.doc_id), d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id)"""

OP8 = f"""WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 33, 1))) AS i FROM w)),
dup AS (SELECT doc_id, i FROM win WHERE h IN (SELECT h FROM win GROUP BY 1 HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM dup),
pos AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM w),
kept AS (SELECT pos.doc_id, string_agg(word, ' ' ORDER BY pos.k) AS text FROM pos LEFT JOIN gone ON gone.doc_id = pos.doc_id AND gone.k = pos.k WHERE gone.k IS NULL GROUP BY 1)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce((SELECT count(*) FROM gone WHERE gone.doc_id = w.doc_id), 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id"""

OP10 = rf"""WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM w)),
rep AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, h) AS c FROM win) WHERE c > 1) GROUP BY 1),
ln AS (SELECT doc_id, unnest(string_split(text, E'\n')) AS line FROM w),
dl AS (SELECT doc_id, sum(c - 1) AS n, sum(c) AS lines FROM (SELECT doc_id, line, count(*) AS c FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1, 2) GROUP BY 1),
c AS (SELECT w.doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dl.n, 0)::BIGINT AS n_dup_lines, coalesce(dl.lines, 0) AS n_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN dl USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c),
h AS (SELECT source, count(*) AS d, count_if(base_failed OR 100 * n_symbols > 30 * n_words OR 100 * n_dup_lines > 30 * n_lines OR 100 * word_chars < 200 * n_words) AS x FROM f GROUP BY 1),
t AS (SELECT sum(d) AS n, sum(x) / sum(d) AS m, count(*) AS k, sum(x * x / d) AS s2 FROM h),
p AS (SELECT m, least(1e6, greatest(2.0, m * (1 - m) / greatest((s2 - n * m * m - (k - 1) * m * (1 - m)) / greatest(1.0, n - k), 1e-9) - 1)) AS s FROM t)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (x + m * s) / (d + s) <= 0.5 AS kept FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source, p"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express; the others are held against plain versions in tests/llm."""
    return {"op4_ngram_jaccard_join": OP4, "op8_substring_dedup": OP8, "op10_quality_rules": OP10}
