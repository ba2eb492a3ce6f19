"""Quality rules with a verdict on each host.

Every text gets counts and a base verdict of its own. What counts against its host is wider: any
rule of `failures` that it fails. These are summed by host, a host's rate is shrunk towards the others
with a beta prior fitted to all hosts, and the documents of a host whose shrunk rate is above
`host_rate` go too. A text that only the wider rules fail, such as a table or code, stays if its host
does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.wordbatch import Words, mix, per_doc, rolling, signed, slices, span_hashes, within
from millrace.session import materialize

WINDOW = 5
MIN_WORDS = 10
REPEAT_PERCENT = 20
#: wider rules: symbols for 100 words, repeated lines of 100 lines, and code points for 100 words. There is
#: no greatest length of words: scripts without blanks have words of any length.
SYMBOL_PERCENT = 30
DUP_LINE_PERCENT = 30
WORD_CHARS_PERCENT = 200
HOST_RATE = 0.5
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _again(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries have an equal one anywhere, and which have an earlier one."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    anywhere, earlier = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    anywhere[order[1:][same]] = True
    anywhere[order[:-1][same]] = True
    earlier[order[1:][same]] = True
    return anywhere, earlier


def text_counts(column, window: int = WINDOW) -> dict[str, np.ndarray]:
    """The counts of each text of a column; n_lines are lines with a word."""
    words = Words(column)
    counts, doc = words.counts, words.doc
    out = {"n_words": counts.astype(np.int64)}
    out["word_chars"] = per_doc(words.inside & ((words.data & 0xC0) != 0x80), words.at)
    out["n_symbols"] = per_doc(_SYMBOL[words.data], words.at)

    # lines with a word: cut at line feeds and at the ends of texts
    cut = np.flatnonzero(words.data == 10)
    start = np.unique(np.concatenate((words.at[:-1], cut + 1)))
    start = start[start < len(words.data)]
    text = np.searchsorted(words.at, start, "right") - 1
    end = np.minimum(np.append(start[1:], len(words.data)), words.at[text + 1])
    end = np.where((end > start) & (words.data[np.maximum(end, 1) - 1] == 10), end - 1, end)
    some = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end, text = start[some], end[some], text[some]
    _, earlier = _again(mix(span_hashes(words.data, start, end) + mix(text.astype(np.uint64))))
    out["n_lines"] = np.bincount(text, minlength=words.n_docs).astype(np.int64)
    out["n_dup_lines"] = np.bincount(text[earlier], minlength=words.n_docs).astype(np.int64)

    h = rolling(words.hashes(), window)
    at = np.flatnonzero(within(counts, window, len(h)))
    anywhere, _ = _again(mix(h[at] + mix(doc[at].astype(np.uint64))))
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, at[anywhere], 1)
    np.add.at(cover, at[anywhere] + window, -1)
    out["n_repeat_words"] = per_doc(np.cumsum(cover)[:-1] > 0, words.of)
    return out


def rule_counts(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, source and the counts of every row of docs, without a shuffle.

    A null text counts as empty; other columns of docs are not read. Rows with the same doc_id or
    text each keep their own row. An empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = text_counts(part.column("text"), window)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), *(pa.array(found[c]) for c in COUNTS)], ["doc_id", "source", *COUNTS])

    columns = [F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")]
    return docs.select(*columns).mapInArrow(run, "doc_id bigint, source string, " + ", ".join(f"{c} bigint" for c in COUNTS))


def failures() -> Column:
    """Whether a row of counts fails any rule; one without words fails by its base verdict."""
    symbols = 100 * F.col("n_symbols") > SYMBOL_PERCENT * F.col("n_words")
    lines = 100 * F.col("n_dup_lines") > DUP_LINE_PERCENT * F.col("n_lines")
    return F.col("base_failed") | symbols | lines | (100 * F.col("word_chars") < WORD_CHARS_PERCENT * F.col("n_words"))


def host_rates(counted: DataFrame) -> DataFrame:
    """source, docs, failures (of any rule) and the shrunk failure rate of each host.

    The prior is Beta(m k, (1 - m) k): m is the share of all documents that fail and k follows from
    how much the hosts' rates differ beyond chance (method of moments, weighted by documents). A
    host of few documents stays near m. Documents without a source form one host.
    """
    hosts = counted.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum(failures().cast("bigint")).alias("failures"))
    one = hosts.agg(F.sum("docs").alias("n"), F.sum("failures").alias("f"), F.count(F.lit(1)).alias("k"), F.sum(F.pow(F.col("failures"), F.lit(2)) / F.col("docs")).alias("s2")).first()
    n, k = one["n"] or 1, one["k"]
    mean = (one["f"] or 0) / n
    # variance between hosts, from the weighted sum of squares less what chance alone gives
    between = ((one["s2"] or 0.0) - n * mean * mean - (k - 1) * mean * (1 - mean)) / max(1.0, n - k)
    strength = min(1e6, max(2.0, mean * (1 - mean) / max(between, 1e-9) - 1))
    return hosts.withColumn("host_rate", (F.col("failures") + mean * strength) / (F.col("docs") + strength))


def quality_rules(docs: DataFrame, host_rate: float = HOST_RATE, min_words: int = MIN_WORDS, repeat_percent: int = REPEAT_PERCENT) -> DataFrame:
    """doc_id, source, the counts, base_failed, host_rate and kept for every row of docs."""
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    counted = materialize(rule_counts(docs).withColumn("base_failed", failed), "rule-counts")
    hosts = host_rates(counted).select(F.col("source").alias("_source"), "host_rate")
    return counted.join(hosts, F.col("source").eqNullSafe(F.col("_source")), "left").select(
        "doc_id", "source", *COUNTS, "base_failed", "host_rate", (~F.col("base_failed") & (F.col("host_rate") <= host_rate)).alias("kept")
    )
