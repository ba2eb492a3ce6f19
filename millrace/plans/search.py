"""Search over chunks: lexical, semantic and hybrid, within a scope, grouped by file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.paths import basename
from millrace.functions.text import snippet
from millrace.operators.catalog import collections_of_files
from millrace.operators.lexical import asks_something, bm25
from millrace.operators.scopes import Scope, in_scope
from millrace.operators.vector import scored_vectors
from millrace.plans.index import Index, build  # noqa: F401  (an index is built and searched from here)
from millrace.session import materialize

RRF_K = 60
MODES = ("lexical", "semantic", "hybrid")


def ranked(hits: DataFrame, *order: str) -> DataFrame:
    """rank of each hit from 1, by score and then the given columns. Hits are at most top_k rows."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.round("score", 9)), *order)).cast("bigint"))


def fuse(lists: list[DataFrame], k: int = RRF_K, keys: tuple[str, ...] = ("file_id", "chunk_id")) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists: the sum of 1 / (k + rank) of each hit."""
    all_ = lists[0].select(*keys, "rank")
    for other in lists[1:]:
        all_ = all_.unionByName(other.select(*keys, "rank"))
    return all_.groupBy(*keys).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def best_per_file(hits: DataFrame, top_k: int) -> DataFrame:
    """The best chunk of each file; the better rank wins ties."""
    best = hits.groupBy("file_id").agg(F.min_by(F.struct(*[c for c in hits.columns if c != "file_id"]), F.struct(-F.round("score", 9), "source_relpath", "chunk_id")).alias("h"))
    return best.select("file_id", "h.*").orderBy(F.desc(F.round("score", 9)), "source_relpath", "chunk_id").limit(top_k)


def indexed_scores(index: Index, query: str, include_zero: bool = False, most: int | None = None, scope: Scope | None = None, members: DataFrame | None = None) -> DataFrame:
    """The scores of an index, or those that may be among the `most` best of a scope; with include_zero those of all chunks, 0 where no term of the query is.

    A query without terms has no hits.
    """
    if not include_zero or not asks_something(index.spark, query):
        return index.scored(query, most, scope, members)
    found = index.scored(query)
    return index.about().drop("dl").join(found.select("chunk_id", "score"), "chunk_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def search(source: DataFrame | Index, query: str, mode: str = "lexical", top_k: int = 10, scope: Scope | None = None, members: DataFrame | None = None, group_by: str | None = None, vectors: DataFrame | None = None, query_vector: list[float] | None = None, overfetch: int | None = None, include_zero: bool = False) -> DataFrame:
    """The top_k hits with snippet, filename, match_type and the collections of their files, best first; ties by path and chunk.

    source is an index, or chunks (file_id, source_relpath, chunk_id, chunk_index, char_start, char_end, text) that
    are scanned; vectors of chunks (chunk_id, embedding) come from the index or are given. A scope is
    applied before the cut, so narrow scopes lose nothing; overfetch=5 cuts to 5 * top_k of the whole corpus
    first. Scores are of the whole corpus either way. The texts of hits are fetched after the cut. Without
    vectors a semantic or hybrid search is a lexical one. group_by='file' keeps the best chunk of each
    file among the top_k. include_zero lets chunks without a term of the query fill up the hits, by path and chunk.
    """
    if mode not in MODES:
        raise ValueError(f"unknown search mode {mode!r}")
    indexed = isinstance(source, Index)
    # one search sees one version of an index
    source = source.pinned() if indexed else source
    if query_vector is None or (vectors is None and not indexed):
        mode = "lexical"
    scope = scope or Scope()
    order = (F.desc(F.round("score", 9)), "source_relpath", "chunk_id")
    chunks = None if indexed else source

    def cut(scored: DataFrame) -> DataFrame:
        if overfetch:
            scored = scored.orderBy(*order).limit(overfetch * top_k)
        return in_scope(scored, scope, members).orderBy(*order).limit(top_k).select("chunk_id", "file_id", "source_relpath", "score")

    # what the cut may take of an index: of the whole corpus where it is cut first, else of the scope
    reach = (overfetch * top_k, None, None) if overfetch else (top_k, scope, members)
    lists = []
    if mode in ("lexical", "hybrid"):
        lists.append(cut(indexed_scores(source, query, include_zero, *reach) if indexed else bm25(chunks, query, top_k=None, include_zero=include_zero)))
    if mode in ("semantic", "hybrid"):
        if vectors is None:
            near = source.near(query_vector, *reach)
        else:
            near = scored_vectors(vectors.join(source.about().drop("dl") if indexed else chunks.drop("text"), "chunk_id"), query_vector)
        lists.insert(0, cut(near))
    if mode == "hybrid":
        # both lists are at most top_k rows: written, so that neither is searched again for the texts
        few = fuse([ranked(x, "source_relpath", "chunk_id") for x in lists], keys=("file_id", "chunk_id", "source_relpath")).orderBy(*order).limit(top_k)
    else:
        few = lists[0]
    few = materialize(few, "hits")
    # at most top_k ids: of an index, they name the files to read
    if indexed:
        named = few.select("chunk_id", "file_id").collect()
        chunks = source.by_ids([r["chunk_id"] for r in named], [r["file_id"] for r in named])
    hits = chunks.join(F.broadcast(few.select("chunk_id", "score")), "chunk_id")
    if {"char_start", "char_end"} <= set(hits.columns):
        hits = hits.withColumn("source_origin", F.struct(F.lit("text_span").alias("grounding_type"), "char_start", "char_end"))
    hits = hits.withColumn("snippet", snippet(F.col("text"))).withColumn("filename", basename(F.col("source_relpath"))).withColumn("match_type", F.lit(mode))
    if members is not None and "name" in members.columns:
        hits = hits.join(collections_of_files(members.join(F.broadcast(few.select("file_id").distinct()), "file_id")), "file_id", "left")
    return best_per_file(hits, top_k) if group_by == "file" else hits.orderBy(*order)
