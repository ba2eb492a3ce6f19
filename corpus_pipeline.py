"""A pipeline from raw documents to packed training sequences.

Each stage reads what the stage before wrote and all but the last return the columns of documents.
Inside a stage a row is followed by a key of all it holds, not by its doc_id, which may be missing or
shared; rows with one key are equal in every column.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.mixing import mix_sources
from millrace.llm.ngram_join import ngram_components
from millrace.llm.packing import pack
from millrace.llm.pii import personal_data
from millrace.llm.queries import vocabulary
from millrace.llm.rules import quality_rules
from millrace.session import materialize, row_key, shared_dir, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: rows that tasks exchange with Python at a time: whole texts are large rows, and a batch is held on both sides
BATCH_ROWS = "500"
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is written inside exchanges small batches; the session's setting is as before afterwards."""
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, before)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(row_key(*COLUMNS).alias("_row"), *COLUMNS)


def _by_key(docs: DataFrame) -> DataFrame:
    """The rows with their key as doc_id."""
    return _keyed(docs).select(F.col("_row").alias("doc_id"), "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality rules or their host's verdict reject.

    Null and empty texts have no words and go; rows without a doc_id, equal rows and rows that share a
    doc_id are each judged by what they hold. An empty table gives an empty one, as in all stages.
    """
    with small_batches(spark):
        kept = materialize(quality_rules(_by_key(docs)).where("kept").select(F.col("doc_id").alias("_row")).distinct(), "kept")
    return _keyed(docs).join(kept, "_row", "left_semi").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near copies (five words, 0.8): that of the least doc_id, if any has one.

    Texts without words are like nothing and all stay; different texts that share a doc_id are told apart.
    """
    with small_batches(spark):
        found = materialize(ngram_components(_by_key(docs), n=5, percent=80).select(F.col("doc_id").alias("_row"), "n_shingles", "component_id").distinct(), "classes")
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "_row")
    least = found.join(_keyed(docs).select("_row", "doc_id"), "_row").groupBy("component_id").agg(F.min(order).alias("least"), F.max("n_shingles").alias("n"))
    kept = least.select("least._row", "n")
    one = F.struct(*COLUMNS)
    # equal rows are copies of each other, but for those without words, which are like nothing
    rows = _keyed(docs).join(kept, "_row").groupBy("_row", "doc_id").agg(F.first(one).alias("d"), F.count(F.lit(1)).cast("int").alias("equal"), F.first("n").alias("n"))
    return rows.select(F.explode(F.array_repeat("d", F.when(F.col("n") > 0, 1).otherwise(F.col("equal")))).alias("d")).select("d.*")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put a mark in place of personal data; a null text stays null, and no row goes."""
    with small_batches(spark):
        clean = materialize(personal_data(docs, keep=("lang", "source")).select("doc_id", "redacted", "lang", "source"), "redacted")
    return clean.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.length("redacted").cast("bigint").alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources have their target weights; rows without a source are one source."""
    copies = mix_sources(_by_key(docs)).groupBy(F.col("doc_id").alias("_row")).agg(F.sum("copies").cast("int").alias("copies")).where("copies > 0")
    # equal rows are one here, with the copies of all of them
    rows = _keyed(docs).groupBy("_row", "doc_id").agg(F.first(F.struct(*COLUMNS)).alias("d")).join(copies, "_row")
    return rows.select(F.explode(F.array_repeat("d", F.col("copies"))).alias("d")).select("d.*")


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens; a null text is an end id alone."""
    with small_batches(spark):
        return materialize(pack(docs, vocabulary(), end_id=0, window=1024), "packed")


STAGES = [
    ("quality rules", keep_good),
    ("n-gram Jaccard join", drop_near_copies),
    ("personal data", redact),
    ("mixing sources", mix),
    ("packing", pack_windows),
]

#: the stages learn models and hash; tests/llm holds them against plain versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    where = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{k}")
        docs = spark.read.parquet(f"{where}/{k}")
    return docs
