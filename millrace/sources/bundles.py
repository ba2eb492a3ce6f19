"""Folders of object bundles as tables: TOML records, JSON lines and texts, read by Spark from any store.

A bundle is a folder objects/<file_id> with meta.toml, provenance.toml, synth.toml, manifest.jsonl and
text.txt. Files are found and read by binaryFile, so a selection of objects is a pattern of the paths that
are listed, and names and sizes alone read no content. Files that can't be read as what they should
be are rows that say so.
"""

from __future__ import annotations

import json
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import strip_fences

#: fixed values: what stands for an answer that isn't TOML
NO_SYNTHESIS, NO_DETAILS = "No synthesis generated.", "The model returned no structured TOML output."
RECORDS = ("meta.toml", "provenance.toml", "synth.toml")
#: ids in a pattern of paths; more objects than this are read by a join after listing
LISTED = 200


def bundle_files(spark: SparkSession, root: str, name: str, files: list[str] | None = None) -> DataFrame:
    """file_id, path, content of one kind of file in the bundles under root, of all objects or of some ids."""
    few = files is not None and len(files) <= LISTED
    which = "{" + ",".join(sorted(set(files))) + "}" if few and files else "*"
    pattern = f"{root}/objects/{which}/{name}"
    found = spark.read.format("binaryFile").load(pattern) if files != [] and _any(spark, pattern) else spark.createDataFrame([], "path string, modificationTime timestamp, length bigint, content binary")
    rows = found.select(F.element_at(F.split("path", "/"), -2).alias("file_id"), "path", "content")
    if files is not None and not few:
        rows = rows.join(spark.createDataFrame([(f,) for f in set(files)], "file_id string"), "file_id", "left_semi")
    return rows


def _any(spark: SparkSession, pattern: str) -> bool:
    """Whether any file fits; a pattern without one is no table to Spark."""
    from pyspark.errors import AnalysisException

    try:
        return bool(spark.read.format("binaryFile").load(pattern).columns)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def toml_json(texts: Column) -> Column:
    """A TOML text as JSON, dates as texts; null where it isn't TOML. TOML has no reader in Spark, so batches go through Python."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(t: str | None) -> str | None:
            try:
                return None if t is None else json.dumps(tomllib.loads(t), default=str)
            except (tomllib.TOMLDecodeError, RecursionError):
                return None

        for b in batches:
            yield b.map(one, na_action="ignore").astype(object)

    return run(texts)


def records(spark: SparkSession, root: str, name: str = "meta.toml", files: list[str] | None = None) -> DataFrame:
    """file_id, record (VARIANT), problem of a kind of TOML file: one row a file; a bad one has no record and says so."""
    rows = bundle_files(spark, root, name, files)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    read = rows.select("file_id", F.try_parse_json(toml_json(text)).alias("record"))
    return read.withColumn("problem", F.when(F.col("record").isNull(), f"{name} isn't TOML"))


def objects(spark: SparkSession, root: str, files: list[str] | None = None) -> DataFrame:
    """file_id, source_relpath, filename, mime, size_bytes, mtime_utc, sha256, problem of the bundles' meta.toml."""
    at = lambda path, kind="string": F.try_variant_get("record", path, kind)
    rows = records(spark, root, "meta.toml", files)
    return rows.select("file_id", at("$.file.source_relpath").alias("source_relpath"), at("$.file.filename").alias("filename"), at("$.file.mime").alias("mime"), at("$.file.size_bytes", "bigint").alias("size_bytes"), at("$.file.mtime_utc").alias("mtime_utc"), at("$.hash.sha256").alias("sha256"), "problem")


def manifest(spark: SparkSession, root: str, files: list[str] | None = None) -> DataFrame:
    """file_id, line (from 1), id, ord, kind, type, char_start, char_end, problem: the records of the manifests; bad lines are rows with a problem."""
    rows = bundle_files(spark, root, "manifest.jsonl", files)
    lines = rows.select("file_id", F.posexplode(F.split(F.col("content").cast("string"), "\n")).alias("i", "text")).where(F.trim(F.regexp_replace("text", "\\s", "")) != "")
    read = lines.select("file_id", (F.col("i") + 1).cast("bigint").alias("line"), F.try_parse_json("text").alias("v"))
    at = lambda path, kind="string": F.try_variant_get("v", path, kind)
    problem = F.when(F.col("v").isNull(), "the line isn't JSON").when(at("$.id").isNull(), "the record has no id")
    return read.select("file_id", "line", at("$.id").alias("id"), at("$.ord", "bigint").alias("ord"), at("$.kind").alias("kind"), at("$.type").alias("type"), at("$.span.char_start", "bigint").alias("char_start"), at("$.span.char_end", "bigint").alias("char_end"), problem.alias("problem"))


def texts(spark: SparkSession, root: str, files: list[str] | None = None) -> DataFrame:
    """file_id, text, problem of the bundles' texts; one that isn't UTF-8 is null."""
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return bundle_files(spark, root, "text.txt", files).select("file_id", text.alias("text"), F.when(text.isNull(), "the text isn't UTF-8").alias("problem"))


def answers_as_records(answers: DataFrame, key: str = "file_id", raw: str = "raw") -> DataFrame:
    """key, synthesis, doc_type, quality, description, fallback of models' answers, which should be TOML in or without a fence.

    One that isn't is kept as it is: its first 300 characters as synthesis, of unknown type and low quality, and
    all of it as description.
    """
    cleaned = strip_fences(F.coalesce(raw, F.lit("")))
    rows = answers.select(key, cleaned.alias("_t")).withColumn("_v", F.try_parse_json(toml_json(F.col("_t"))))
    at = lambda path: F.try_variant_get("_v", path, "string")
    bad, some = F.col("_v").isNull(), F.col("_t") != ""
    pick = lambda path, other: F.when(bad, other).otherwise(at(path))
    return rows.select(
        key, pick("$.synthesis.synthesis", F.when(some, F.btrim(F.left("_t", F.lit(300)), F.lit(" \t\n\r\x0b\x0c"))).otherwise(NO_SYNTHESIS)).alias("synthesis"), pick("$.synthesis.doc_type", F.lit("unknown")).alias("doc_type"),
        pick("$.synthesis.quality", F.lit("low")).alias("quality"), pick("$.details.description", F.when(some, F.col("_t")).otherwise(NO_DETAILS)).alias("description"), bad.alias("fallback"),
    )
