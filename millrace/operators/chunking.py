"""Chunks of texts with their places in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import SPACE, leading, strip

PARAGRAPH = r"(?sd)\S(?:.*?\S)?(?:\n\s*\n|$)"


#: windows that are cut out of one piece of a text, so that a long text isn't searched from its start for each
PER_PIECE = 128


def windows(texts: DataFrame, size: int, overlap: int) -> DataFrame:
    """The other columns of texts, chunk_index (from 1), char_start, char_end, text: overlapping windows, stripped.

    Empty windows are left out and don't count in the index. There is no shuffle: which windows of a text
    are empty is found first, where it has enough white space in a row for one.
    """
    rest, step = [c for c in texts.columns if c != "text"], max(1, size - overlap)
    text = F.col("text")
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - size) / F.lit(float(step))).cast("int"))
    empty = F.filter(F.sequence(F.lit(0), last), lambda k: strip(F.substring(text, k * step + 1, F.lit(size))) == "")
    empty = F.when(text.rlike(f"{SPACE}{{{min(size - step, size - 1) + 1},}}"), empty).otherwise(F.array().cast("array<int>"))
    pieces = texts.select(*rest, text, empty.alias("_empty"), last.alias("_last")).withColumn("_piece", F.explode(F.sequence(F.lit(0), F.floor(F.col("_last") / PER_PIECE).cast("int"))))
    first = F.col("_piece") * PER_PIECE
    pieces = pieces.select(*rest, "_empty", first.alias("_first"), F.least(F.lit(PER_PIECE - 1), F.col("_last") - first).alias("_more"), F.substring(text, first * step + 1, F.lit((PER_PIECE - 1) * step + size)).alias("_text"))
    rows = pieces.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_more")))).withColumn("_k", F.col("_first") + F.col("_i")).where("NOT array_contains(_empty, _k)")
    raw = rows.select(*rest, "_k", (F.col("_k") + 1 - F.size(F.filter("_empty", lambda e: e < F.col("_k")))).cast("bigint").alias("chunk_index"), F.substring(F.col("_text"), F.col("_i") * step + 1, F.lit(size)).alias("_raw"))
    own = raw.select(*rest, "chunk_index", (F.col("_k") * step + leading(F.col("_raw"))).cast("bigint").alias("char_start"), strip(F.col("_raw")).alias("text"))
    return own.select(*rest, "chunk_index", "char_start", (F.col("char_start") + F.length("text")).cast("bigint").alias("char_end"), "text")


def paragraph_spans(text: Column) -> Column:
    """start, end and text of the paragraphs, in order.

    A paragraph ends at a non-blank that stands right before a blank line, or at the end of the text.
    """
    found = F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0))
    state = F.aggregate(
        found,
        F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<char_start:bigint,char_end:bigint,text:string>>").alias("out")),
        lambda s, m: F.struct(
            (_locate(m, text, s["at"]) + F.length(m)).alias("at"),
            F.array_append(s["out"], F.struct((_locate(m, text, s["at"]) - 1).cast("bigint").alias("char_start"), (_locate(m, text, s["at"]) - 1 + F.length(strip(m))).cast("bigint").alias("char_end"), strip(m).alias("text"))).alias("out"),
        ),
    )
    return state["out"]


def _locate(part: Column, text: Column, start: Column) -> Column:
    return F.call_function("locate", part, text, start)


def chunks(texts: DataFrame, method: str = "paragraph", size: int = 1200, overlap: int = 200, key: str = "file_id") -> DataFrame:
    """One row a chunk of texts(key, text): key, chunk_id, chunk_index (from 1), char_start, char_end, text.

    Blank texts have no chunks.
    """
    if method not in ("paragraph", "window"):
        raise ValueError(f"unknown chunk method {method!r}")
    some = texts.where(strip(F.col("text")) != "")
    rest = [c for c in texts.columns if c != "text"]
    if method == "paragraph":
        rows = some.select(*rest, F.posexplode(paragraph_spans(F.col("text"))).alias("i", "s"))
        rows = rows.select(*rest, (F.col("i") + 1).cast("bigint").alias("chunk_index"), "s.*")
    else:
        rows = windows(some, size, overlap)
    return rows.select(*rest, F.format_string("chunk-%s-%06d", F.col(key).cast("string"), F.col("chunk_index")).alias("chunk_id"), "chunk_index", "char_start", "char_end", "text")


def chunk_records(files: DataFrame, preferred: DataFrame, method: str = "paragraph", size: int = 1200, overlap: int = 200, key: str = "file_id") -> DataFrame:
    """The chunks of the preferred texts of files, with what they were cut from: the rows that an index is built of.

    files holds key and source_relpath; preferred key, representation, kind and text. The columns are those
    of chunks, source_relpath, source_text_representation, source_text_kind and chunk_method. Files without a
    preferred text, and blank texts, have no chunks.
    """
    texts = files.select(key, "source_relpath").join(preferred.select(key, F.col("representation").alias("source_text_representation"), F.col("kind").alias("source_text_kind"), "text"), key)
    return chunks(texts, method, size, overlap, key).withColumn("chunk_method", F.lit(method))
