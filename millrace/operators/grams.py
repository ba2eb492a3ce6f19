"""Search inside segments: an index of trigrams, whose candidates are verified, so any needle is found exactly."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from millrace.session import materialize

#: grams of a needle that are looked up: the rarest ones; more would only make candidates fewer before they are verified
LOOKED_UP = 6
#: segments of a block at most: a list of a gram names those of one block by their places in it
BLOCK = 4_096
#: segments whose texts one task compares with needles, about
TOGETHER = 16_384
LISTS = "gram string, block bigint, places array<int>"


def grams(text: Column) -> Column:
    """The distinct runs of three characters of a text, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(...))"), F.lit(1)))


def _listed(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The lists of numbered arrays of distinct grams: for each gram and block the places of its segments, in order.

    A block is named by the number of its first segment, and has at most one list of a gram.
    """

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(0).to_numpy() // size
            starts = np.flatnonzero(np.r_[True, whole[1:] != whole[:-1]]) if len(whole) else []
            for start, end in zip(starts, [*starts[1:], len(whole)], strict=True):
                numbers, found = batch.column(0).to_numpy()[start:end], batch.column(1).slice(start, end - start)
                counts = pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False)
                coded = found.flatten().dictionary_encode()
                if not len(coded):
                    continue
                pairs = np.sort(coded.indices.to_numpy().astype(np.int64) * len(numbers) + np.repeat(np.arange(len(numbers)), counts))
                code, row = np.divmod(pairs, len(numbers))
                first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
                places = pa.ListArray.from_arrays(pa.array(np.r_[first, len(pairs)].astype(np.int32)), pa.array((numbers[row] - numbers[0]).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(code[first])), pa.array(np.full(len(first), numbers[0])), places], names=["gram", "block", "places"])

    return lists


def write_grams(segments: DataFrame, path: str, keys: tuple[str, ...] = ("file_id", "segment_id"), block: int = BLOCK) -> None:
    """Write segments (keys, text), the lists of segments of each gram, and how many those are.

    Nothing but counts is shuffled. Each task numbers its segments; lists hold these numbers, block by block, and are made in
    the task that reads the texts and sorted by gram in each file, so a frequent gram is in many files and what a
    task holds doesn't grow with the table. Null texts have no grams.
    """
    spark = segments.sparkSession
    own = segments.select(*keys, "text")
    own.withColumn("_num", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(f"{path}/segments")
    numbered = spark.read.schema(StructType([*own.schema.fields, StructField("_num", LongType())])).parquet(f"{path}/segments")
    lists = numbered.select("_num", grams(F.col("text")).alias("_g")).mapInArrow(_listed(block), LISTS)
    lists.sortWithinPartitions("gram", "block").write.option("compression", "zstd").parquet(f"{path}/postings")
    counted = spark.read.schema(LISTS).parquet(f"{path}/postings").groupBy("gram").agg(F.sum(F.size("places")).alias("n"))
    counted.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{path}/counts")


def find(spark: SparkSession, path: str, needles: DataFrame, needle_id: str = "needle_id", keys: tuple[str, ...] = ("file_id", "segment_id")) -> DataFrame:
    """needle_id and the keys of every segment that contains the needle (needle_id, needle), whatever its case.

    White space around a needle doesn't count; blank and null needles are found nowhere. Of each needle its
    rarest grams are looked up, the segments that have all of them are read and compared with the whole
    needle. Needles of one or two characters have no gram and are compared with every segment, in one pass.
    """
    n = F.lower(F.btrim("needle", F.lit(" \t\n\r\x0b\x0c")))
    asked = needles.select(needle_id, n.alias("_needle")).where("_needle <> ''")
    counts = spark.read.parquet(f"{path}/counts")
    of = asked.where(F.length("_needle") >= 3).select(needle_id, F.explode(grams(F.col("_needle"))).alias("gram"))
    # a gram that no segment has: its needle is found nowhere
    rare = of.join(counts, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    place = F.row_number().over(Window.partitionBy(needle_id).orderBy("n", "gram"))
    rare = rare.withColumn("_p", place).where(F.col("_p") <= LOOKED_UP).select(needle_id, "gram", F.count(F.lit(1)).over(Window.partitionBy(needle_id)).alias("_of"))
    rare = materialize(rare, "rare-grams")
    # of a block a gram has one list: a segment that is in all lists of a needle has all its grams
    met = spark.read.parquet(f"{path}/postings").join(rare, "gram").groupBy(needle_id, "_of", "block").agg(F.collect_list("places").alias("_lists")).where(F.size("_lists") == F.col("_of"))
    every = F.aggregate(F.slice("_lists", 2, F.size("_lists")), F.col("_lists")[0], F.array_intersect)
    met = met.select(needle_id, "block", F.explode(every).alias("_place")).select(needle_id, (F.col("block") + F.col("_place")).alias("_num"))
    segments = spark.read.parquet(f"{path}/segments").select(*keys, "_num", F.lower("text").alias("_text"))
    # as many tasks as the texts need
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-segments.count() // TOGETHER))
    met = met.join(asked, needle_id).repartition(tasks, "_num")
    long = met.join(segments.repartition(tasks, "_num"), "_num").where(F.contains("_text", "_needle")).select(needle_id, *keys)
    # needles of two characters at most: as many different ones as pairs of characters, however often they are asked
    few = asked.where(F.length("_needle") < 3)
    short = few.select("_needle").distinct()
    everywhere = segments.join(short, F.contains("_text", "_needle")).select("_needle", *keys).join(few, "_needle").select(needle_id, *keys)
    return long.unionByName(everywhere)
