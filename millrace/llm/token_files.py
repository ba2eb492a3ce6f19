"""Token-id files in document order.

A file is a Parquet file whose rows are blocks of the format of token_codec, each with the ids of
its documents (doc_id, number of ids): so it can be kept in any store that Spark writes to, a block
can be read without the others, and a lost task writes its file again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import token_codec
from millrace.llm.tokens import TextEncoder
from millrace.llm.wordbatch import slices

#: ids of a block; one document is never cut
BLOCK_IDS = 1 << 21
BLOCKS = "file int, block int, n_ids bigint, doc_ids array<bigint>, lengths array<int>, code binary"


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, partitions: int | None = None) -> None:
    """Write the ids of every text of docs, in ascending doc_id order, to a new folder.

    Each text (a null one is empty) is followed by end_id. Files are numbered in order of doc_id;
    rows without a doc_id come first and rows that share one are in order of their text. An empty
    table gives files without blocks.
    """
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = TextEncoder.of(vocabulary).library.get_vocab_size()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, file, block = TextEncoder.of(vocabulary), TaskContext.get().partitionId(), 0
        parts, names, lengths, held = [], [], [], 0

        def out():
            ids = np.concatenate(parts)
            row = [pa.array([file], pa.int32()), pa.array([block], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int32())), pa.array([token_codec.encode(ids, size)], pa.binary())]
            return pa.RecordBatch.from_arrays(row, ["file", "block", "n_ids", "doc_ids", "lengths", "code"])

        for part in slices(batches):
            ids, at = encoder.encode(part.column("text"))
            ids = np.insert(ids, at[1:], end_id)
            at = at + np.arange(len(at))
            first = 0
            name = part.column("doc_id").to_pylist()
            while first < len(name):
                # whole documents, until the block is full
                last = max(int(np.searchsorted(at, at[first] + BLOCK_IDS - held, "right")) - 1, first + (not held))
                parts.append(ids[at[first] : at[last]])
                names += name[first:last]
                lengths += np.diff(at[first : last + 1]).tolist()
                held += int(at[last] - at[first])
                first = last
                if first < len(name) or held >= BLOCK_IDS:
                    yield out()
                    block += 1
                    parts, names, lengths, held = [], [], [], 0
        if held:
            yield out()

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, BLOCKS).write.parquet(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document, from the files alone.

    start counts the ids of all documents before it. Each block is checked against its checksums;
    one that is damaged fails the read.
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = token_codec.decode(batch.column("code")[i].as_py())
                lengths = np.array(batch.column("lengths")[i].as_py(), np.int64)
                if int(lengths.sum()) != len(ids):
                    raise token_codec.BlockError("the documents' lengths don't add up to the block's")
                at = np.append(0, np.cumsum(lengths))
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                n = len(lengths)
                row = [pa.array(np.full(n, batch.column(c)[i].as_py(), np.int32)) for c in ("file", "block")]
                row += [batch.column("doc_ids").slice(i, 1).flatten(), pa.array(at[:-1]), pa.array(lengths), pa.array(crc, pa.int64())]
                if with_ids:
                    row.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(row, ["file", "block", "doc_id", "before", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    found = blocks.mapInArrow(run, "file int, block int, doc_id bigint, before bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)
    # files before a block, then blocks before it in its file: one row a file, then one a block
    files = blocks.groupBy("file").agg(F.sum("n_ids").alias("n")).select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("files_before"))
    inside = blocks.select("file", "block", (F.sum("n_ids").over(Window.partitionBy("file").orderBy("block")) - F.col("n_ids")).alias("blocks_before"))
    starts = inside.join(files, "file")
    return found.join(starts, ["file", "block"]).select("doc_id", (F.col("files_before") + F.col("blocks_before") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
