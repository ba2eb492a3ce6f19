"""Many questions at once: a table of questions is joined with the postings of an index."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from millrace.functions.paths import basename
from millrace.functions.text import search_tokens, snippet
from millrace.operators.lexical import BLOCK, K1, B
from millrace.operators.scopes import Scope, in_scope
from millrace.plans.index import Index
from millrace.session import materialize


#: questions that one task scores at a time
TOGETHER = 256


def best_many(index: Index, questions: DataFrame, top_k: int, scope: Scope | None = None, members: DataFrame | None = None, question: str = "question_id", k1: float = K1, b: float = B) -> DataFrame:
    """question, chunk_id, file_id, source_relpath and the BM25 score of the top_k chunks in the scope of each question (question, text) and block of the index.

    The lists of a block meet the chunks that it has in the scope, and are added up there for many questions, so hits that
    another chunk of their block beats are never rows. A block is of bounded size, and so are the questions of a task.
    """
    index = index.pinned()
    asked = questions.select(question, F.explode(search_tokens(F.col("text"))).alias("term")).groupBy(question, "term").agg(F.count(F.lit(1)).alias("_times"))
    asked = materialize(asked, "question-terms")
    groups = max(1, -(-asked.select(question).distinct().count() // TOGETHER))
    lists = index.lists().join(asked.select("term").distinct(), "term", "left_semi")
    df = index.postings().join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("_df")) if index.has_dead() else lists.groupBy("term").agg(F.sum(F.size("places")).alias("_df"))
    n, avgdl = index.stats()
    gain = F.ln(1.0 + (n - F.col("_df") + 0.5) / (F.col("_df") + 0.5)) * F.col("_times")
    asks = asked.join(df, "term").withColumn("_group", F.pmod(F.xxhash64(question), F.lit(groups))).groupBy("term", "_group").agg(F.collect_list(F.struct(F.col(question).alias("q"), gain.alias("w"))).alias("_asks"))
    keys = ["_group", "_seq", "block"]
    left = lists.join(asks, "term").select(*keys, "places", "tfs", "dls", F.col("_asks.q").alias("q"), F.col("_asks.w").alias("w"))
    right = in_scope(index.numbered(), scope or Scope(), members).crossJoin(index.spark.range(groups).select(F.col("id").alias("_group")))
    right = right.select("_group", "_seq", F.floor(F.col("_num") / BLOCK).alias("block"), (F.col("_num") % BLOCK).cast("int").alias("place"), "chunk_id", "file_id", "source_relpath")
    mean = avgdl or 1.0

    def best(lists: pd.DataFrame, chunks: pd.DataFrame) -> pd.DataFrame:
        scores: dict = {}
        for places, tfs, dls, qs, ws in zip(lists["places"], lists["tfs"], lists["dls"], lists["q"], lists["w"], strict=True):
            part = tfs / (tfs + k1 * (1 - b + b * dls / mean))
            for q, w in zip(qs, ws, strict=True):
                q = None if q != q else q
                if q not in scores:
                    scores[q] = np.zeros(BLOCK)
                scores[q][places] += w * part
        out, place = [chunks.iloc[:0].assign(q=None, score=0.0)], chunks["place"].to_numpy()
        for q, of_place in scores.items():
            own = np.round(of_place[place], 9)
            some = np.flatnonzero(of_place[place] > 0)
            if len(some) > top_k:
                some = some[own[some] >= np.partition(own[some], len(some) - top_k)[len(some) - top_k]]
            few = chunks.iloc[some].assign(q=q, score=of_place[place[some]], own=-own[some])
            out.append(few.sort_values(["own", "source_relpath", "chunk_id"]).head(top_k))
        return pd.concat([x for x in out if len(x)] or out).rename(columns={"q": question})[[question, "chunk_id", "file_id", "source_relpath", "score"]]

    kind = StructType([questions.schema[question], *[index.numbered().schema[c] for c in ("chunk_id", "file_id", "source_relpath")], StructField("score", DoubleType())])
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, kind)


def search_many(index: Index, questions: DataFrame, top_k: int = 10, scope: Scope | None = None, members: DataFrame | None = None, question: str = "question_id", texts: bool = True) -> DataFrame:
    """The top_k hits of each question, with their rank; with `texts` their text, snippet and filename.

    They are those of a search for each question by itself. Each block of the index leaves at most top_k hits of a
    question, so no task sees all hits of one. Questions without hits have no rows; equal
    question ids are one question.
    """
    index = index.pinned()
    found = best_many(index, questions, top_k, scope, members, question)
    place = F.row_number().over(Window.partitionBy(question).orderBy(F.desc(F.round("score", 9)), "source_relpath", "chunk_id"))
    hits = found.withColumn("rank", place).where(F.col("rank") <= top_k)
    if not texts:
        return hits
    hits = materialize(hits, "many-hits")
    chunks = index.chunks().drop("shard", "file_id", "source_relpath")
    return hits.join(chunks, "chunk_id").withColumn("snippet", snippet(F.col("text"))).withColumn("filename", basename(F.col("source_relpath")))


def search_with_fallback(index: Index, questions: DataFrame, preferred: Scope, fallback: Scope, top_k: int = 10, members: DataFrame | None = None, question: str = "question_id", texts: bool = True) -> DataFrame:
    """The hits of search_many in the preferred scope, and in the fallback scope for questions that have none there; used says which."""
    index = index.pinned()
    first = search_many(index, questions, top_k, preferred, members, question, texts=False)
    first = materialize(first, "preferred-hits")
    left = questions.join(first.select(question).distinct(), question, "left_anti")
    other = search_many(index, left, top_k, fallback, members, question, texts=False)
    hits = materialize(first.withColumn("used", F.lit("preferred")).unionByName(other.withColumn("used", F.lit("fallback"))), "fallback-hits")
    if not texts:
        return hits
    chunks = index.chunks().drop("shard", "file_id", "source_relpath")
    return hits.join(chunks, "chunk_id").withColumn("snippet", snippet(F.col("text"))).withColumn("filename", basename(F.col("source_relpath")))


def evidence(hits: DataFrame, question: str = "question_id", most: int = 8, size: int = 1200) -> DataFrame:
    """question, evidence, n_sources: the first hits of each question as numbered passages with their files, for a prompt.

    At most `most` passages of `size` characters: a bounded text whatever a question found.
    """
    line = F.format_string("[%d] %s\n%s", F.col("rank"), F.col("source_relpath"), F.left(F.btrim("text"), F.lit(size)))
    few = hits.where(F.col("rank") <= most)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n\n")
    return few.groupBy(question).agg(joined.alias("evidence"), F.count(F.lit(1)).alias("n_sources"))
