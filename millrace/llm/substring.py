"""Substring deduplication by seed and extend.

Seeds: of each window of `window` words, the least hashed k-gram is its anchor (winnowing), so equal
windows have equal anchors at equal places. Consecutive windows with one anchor form a run. Anchors
are joined across all documents. Runs that are equal as a whole are settled as a whole, whatever the
number of copies; where an anchor has different runs, each distinct run is extended to both sides of
the anchor once, window by window, and its windows are matched with those of the others. Windows that
repeat and follow one another, in runs of whichever anchors, merge: a repeat ends where the next window
to the left or right has no equal anywhere, so it is maximal, and its length is window or more. The
words of all repeats go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.wordbatch import Words, leftmost_minimum, mix, rolling, signed, slices, within
from millrace.session import materialize, row_key

WINDOW = 35
SEED = 16


def _runs(words: Words, window: int, seed: int):
    """Windows' hashes, each window's text, and the first window, length and anchor of each run."""
    counts = words.counts
    h = words.hashes()
    whole = rolling(h, window)
    grams = rolling(h, seed)
    anchor = leftmost_minimum(grams, window - seed + 1)
    keep = np.flatnonzero(within(counts, window, len(whole)))
    doc = words.doc[keep] if len(keep) else keep
    place = anchor[keep]
    new = np.ones(len(keep), bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(keep)))
    return h, whole, keep, doc, grams[place[first]] if len(first) else np.zeros(0, np.uint64), place[first] - keep[first], first, length


def seeds(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """row, first, length, anchor, content: the runs of windows that have one anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = Words(part.column("text"))
            h, whole, keep, doc, anchor, offset, first, length = _runs(words, window, seed)
            # content: all words of the run, and where its anchor stands
            total = np.zeros(len(whole) + 1, np.uint64)
            np.cumsum(mix(whole + np.uint64(7)), out=total[1:])
            at = keep[first] if len(first) else first
            content = mix(total[at + length] - total[at] + mix(whole[at] + offset.astype(np.uint64) * np.uint64(1 << 32) + length.astype(np.uint64)))
            ids = part.column("row").to_numpy(zero_copy_only=False)
            text = doc[first] if len(first) else first
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[text], pa.int64()), pa.array((at - words.of[text]).astype(np.int64)), pa.array(length.astype(np.int32)), pa.array(signed(anchor)), pa.array(signed(content))],
                ["row", "first", "length", "anchor", "content"],
            )

    return docs.mapInArrow(run, "row bigint, first bigint, length int, anchor bigint, content bigint")


def _window_hashes(texts: DataFrame, window: int) -> DataFrame:
    """Extend: the windows of the runs that are listed with each text, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = Words(part.column("text"))
            whole = signed(rolling(words.hashes(), window))
            runs = part.column("runs").combine_chunks() if isinstance(part.column("runs"), pa.ChunkedArray) else part.column("runs")
            each = np.diff(runs.offsets.to_numpy())
            flat = runs.flatten()
            text = np.repeat(np.arange(len(each)), each)
            first = flat.field("first").to_numpy() + words.of[text]
            length = flat.field("length").to_numpy()
            index = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(flat.field("anchor").to_numpy(), length)),
                    pa.array(np.repeat(flat.field("content").to_numpy(), length)),
                    pa.array(np.repeat(flat.field("copies").to_numpy(), length)),
                    pa.array(index.astype(np.int32)),
                    pa.array(whole[np.repeat(first, length) + index]),
                ],
                ["anchor", "content", "copies", "index", "hash"],
            )

    return texts.mapInArrow(run, "anchor bigint, content bigint, copies bigint, index int, hash bigint")


def _known(docs: DataFrame) -> DataFrame:
    """The texts and a key of each row, in a form whose shuffle by that key all joins of one query share."""
    return docs.select(row_key("doc_id", "text").alias("row"), "doc_id", "text")


def repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """What repeats in each text: row, marks (array of first, length, windows).

    windows lists which windows of the run repeat; null stands for all. A window is judged on the
    input as it is, and repeats within one document count. Equal rows share their key and so their
    marks; each counts for itself.
    """
    found = materialize(seeds(_known(docs), window, seed), "seeds")
    # written, so that the join is of two plain shuffles, whose hot anchors Spark can split
    shared = materialize(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "anchors")
    found = materialize(found.join(shared, "anchor", "left_semi"), "shared-seeds")
    runs = found.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("row", "first", "length")).alias("one"))
    # anchors with several different runs: only there can single windows match
    several = runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    mixed = runs.join(several, "anchor", "left_semi").groupBy(F.col("one.row").alias("row")).agg(F.collect_list(F.struct("anchor", "content", "copies", F.col("one.first").alias("first"), F.col("one.length").alias("length"))).alias("runs"))
    windows = _window_hashes(_known(docs).join(mixed, "row"), window)
    matched = materialize(windows.groupBy("anchor", "hash").agg(F.sum("copies").alias("n")).where("n > 1").select("anchor", "hash"), "matched")
    partial = windows.where("copies = 1").join(matched, ["anchor", "hash"], "left_semi").groupBy("anchor", "content").agg(F.collect_list("index").alias("windows"))
    whole = runs.where("copies > 1").select("anchor", "content", F.lit(None).cast("array<int>").alias("windows"))
    # written for the same reason: a passage that a third of all rows have is one anchor and content
    verdicts = materialize(whole.unionByName(partial), "verdicts")
    return found.join(verdicts, ["anchor", "content"]).groupBy("row").agg(F.collect_set(F.struct("first", "length", "windows")).alias("marks"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED, text_out: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and repeats, kept_text): texts without their repeated words.

    Each word covered by a window of `window` words that also starts anywhere else is removed; kept
    words are joined by one space. repeats lists first word and length of each maximal repeat, which may
    overlap. A null text has no words. Rows are told apart by doc_id and text, so those without a
    doc_id, or with one that others have too, take part like any other. Other columns of docs aren't
    read; an empty table gives an empty one.
    """
    marks = repeats(docs, window, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = Words(part.column("text"))
            starts = np.zeros(len(words) + 1, np.int64)
            for d, found in enumerate(part.column("marks").to_pylist()):
                base, n = words.of[d], words.counts[d]
                for m in found or ():
                    spans = [(m["first"], m["length"])] if m["windows"] is None else [(m["first"] + i, 1) for i in m["windows"]]
                    for first, length in spans:
                        if first + length + window - 1 <= n:
                            starts[base + first] += 1
                            starts[base + first + length] -= 1
            # stretches of repeated windows, text by text
            again, head = np.cumsum(starts)[:-1] > 0, np.zeros(len(words) + 1, bool)
            head[words.of] = True
            begin = np.flatnonzero(again & (head[:-1] | ~np.append(False, again[:-1])))
            end = np.flatnonzero(again & (head[1:] | ~np.append(again[1:], False))) + window
            cover = np.zeros(len(words) + window + 1, np.int64)
            np.add.at(cover, begin, 1)
            np.add.at(cover, end, -1)
            gone = np.cumsum(cover)[: len(words)] > 0
            removed = np.add.reduceat(np.append(gone, False).astype(np.int64), words.of[:-1]) if words.n_docs else gone
            removed = np.where(words.counts > 0, removed, 0)
            raw = words.data.tobytes()
            kept, digest = [], []
            for d in range(words.n_docs):
                a, b = words.of[d], words.of[d + 1]
                if removed[d]:
                    text = b" ".join([raw[s:e] for s, e, g in zip(words.start[a:b].tolist(), words.end[a:b].tolist(), gone[a:b].tolist(), strict=True) if not g])
                else:
                    text = b" ".join(raw[words.at[d] : words.at[d + 1]].split())
                digest.append(hashlib.sha256(text).hexdigest())
                kept.append(text.decode() if text_out else None)
            columns = [part.column("doc_id"), pa.array(words.counts.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(digest)]
            if text_out:
                of = np.searchsorted(begin, words.of)
                spans = pa.StructArray.from_arrays([pa.array(begin - words.of[np.searchsorted(words.of, begin, "right") - 1]), pa.array(end - begin)], ["first", "length"])
                columns += [pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), spans), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["repeats", "kept_text"] * text_out
    kind = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", repeats array<struct<first:bigint,length:bigint>>, kept_text string" * text_out
    return _known(docs).join(marks, "row", "left").mapInArrow(run, kind)
