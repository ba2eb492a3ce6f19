"""The tables of a corpus, from the driver's tables or from files."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import paths
from millrace.functions.text import ordered_text, strip, strip_rtf


def file_id(content: Column) -> Column:
    return F.concat(F.lit("sha256-"), F.sha2(content, 256))


def objects(documents: DataFrame) -> DataFrame:
    """One object a document: its content id, its path source/lang/doc-<id>.txt, and its text."""
    relpath = F.concat_ws("/", "source", "lang", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return documents.select("doc_id", file_id(F.col("text")).alias("file_id"), relpath.alias("source_relpath"), F.octet_length("text").cast("bigint").alias("size_bytes"), "text")


def first_by_content(objs: DataFrame) -> DataFrame:
    """One row a content id, the one of the least path."""
    return objs.groupBy("file_id").agg(F.min(F.struct("source_relpath", "doc_id", "size_bytes", "text")).alias("o")).select("file_id", "o.*")


def conversation_texts(conversations: DataFrame) -> DataFrame:
    """conv_id, text: the turns of each conversation, a blank line between."""
    return conversations.groupBy("conv_id").agg(ordered_text(F.col("turn"), F.col("text")).alias("text"))


def collections(documents: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Collections 'good' and 'toxic' and their members, from the labels."""
    objs = objects(documents).select("doc_id", "file_id")
    named = labels.select("doc_id", F.explode(F.array_compact(F.array(F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic")))).alias("name"))
    members = named.join(objs, "doc_id").select(F.concat(F.lit("col-"), F.left(F.sha2("name", 256), F.lit(12))).alias("collection_id"), "name", "file_id", F.col("doc_id").alias("created"))
    members = members.groupBy("collection_id", "name", "file_id").agg(F.min("created").alias("created"))
    return members.select("collection_id", "name").distinct(), members


# files ---------------------------------------------------------------------------------------


def files(spark: SparkSession, root: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """path, content, length and time of every file under a folder, in any store that Spark reads."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", glob).load(root)


def _office_text(data: bytes, members: str) -> str:
    """The texts of an office file's members; one that isn't well-formed is skipped."""
    parts = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for name in sorted(n for n in z.namelist() if re.match(members, n) and n.endswith(".xml")):
            try:
                parts.append(" ".join(t.strip() for t in ElementTree.fromstring(z.read(name)).itertext() if t.strip()))
            except ElementTree.ParseError:
                continue
    return "\n\n".join(p for p in parts if p)


#: which members of an office file hold its text
OFFICE = {".docx": r"word/document", ".pptx": r"ppt/slides/", ".xlsx": r"xl/(sharedStrings|worksheets/)"}
PLAIN = (".txt", ".md", ".csv", ".json", ".html", ".htm", ".xml", ".log", ".tsv", ".yaml", ".yml", ".toml", ".ini", ".py", ".js", ".ts", ".java", ".c", ".cpp", ".rst", ".sql", ".sh")


def extracted(found: DataFrame, extractors: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """path, text, status of each file of files(): plain text and RTF natively, office files in batches.

    Other suffixes need an extractor in `extractors` (suffix -> function of the bytes); without one
    their status is 'unsupported'. A file that can't be read has status 'error', an empty text 'empty'.
    """
    more = dict(extractors or {})
    kind = paths.suffix(F.col("path"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, suffix, content in batch.itertuples(index=False):
                try:
                    rows.append((path, more[suffix](content) if suffix in more else _office_text(content, OFFICE[suffix]), None))
                except Exception as e:  # one bad file must not end the job; its row says so
                    rows.append((path, None, str(e)[:200]))
            yield pd.DataFrame(rows, columns=["path", "text", "problem"])

    plain = found.where(kind.isin(*PLAIN)).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.lit(None).cast("string").alias("problem"))
    rtf = found.where(kind == ".rtf").select("path", strip_rtf(F.make_valid_utf8(F.col("content").cast("string"))).alias("text"), F.lit(None).cast("string").alias("problem"))
    read = found.where(kind.isin(*OFFICE, *more)).select("path", kind.alias("suffix"), "content").mapInPandas(run, "path string, text string, problem string")
    other = found.where(~kind.isin(*PLAIN, ".rtf", *OFFICE, *more)).select("path", F.lit(None).cast("string").alias("text"), F.lit("unsupported").alias("problem"))
    status = F.when(F.col("problem") == "unsupported", "unsupported").when(F.col("problem").isNotNull(), "error").when(F.trim(F.coalesce("text", F.lit(""))) == "", "empty").otherwise("done")
    return plain.unionByName(rtf).unionByName(read).unionByName(other).withColumn("status", status)


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good records, and the lines that are none (blank lines are neither)."""
    rows = spark.read.text(path).where(F.trim("value") != "").select("value", F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return rows.where("r._bad IS NULL").select("r.*").drop("_bad"), rows.where("r._bad IS NOT NULL").select(F.left("value", F.lit(200)).alias("preview"))


def line_counts(good: DataFrame, bad: DataFrame) -> DataFrame:
    """good, bad: how many lines of json_lines() are records; without any good one it is an error to go on."""
    n = good.agg(F.count(F.lit(1)).alias("good")).join(bad.agg(F.count(F.lit(1)).alias("bad")))
    return n.select(F.when(F.col("good") == 0, F.raise_error(F.lit("no valid records"))).otherwise(F.col("good")).alias("good"), "bad")


def html_text(html: Column) -> Column:
    """Readable text of a page: without scripts, styles, comments and tags; common entities decoded."""
    out = F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|table|section|article)\b[^>]*>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", "")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return strip(F.regexp_replace(F.regexp_replace(out, "[ \t]+", " "), r"\s*\n\s*", "\n"))
