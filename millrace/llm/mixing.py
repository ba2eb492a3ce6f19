"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

A document of size s in a source whose target is f times its size is wanted f times: floor(f) whole
copies and a fraction, counted here in words (x of s words). Pivotal steps meet two fractions at a
time and move words from one to the other at random, so that the expected words of both stay as they
are, until one is none or whole; the sum of both never changes. Documents meet in buckets of bounded
size, one fraction of each bucket survives, and the survivors meet again: a reduction tree whose
depth grows with the logarithm of the number of documents. The last fraction of a source is rounded
to the nearer end, so a source misses its target by half a document at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import materialize

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_COPIES = 2.0
#: fractions that meet in one bucket, on average
BUCKET = 32
#: equal rows that are written out by one task
PIECE = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """source, source_size, target: share of all words, split by weight, none above `most` times its words.

    Sources weigh weights[0], weights[1], ... in code-point order, null last, repeating. What a
    source can't take is shared again by weight: the targets are min(level * weight, most * size)
    for the one level at which they add up. Sources are ordered by the level at which each is full;
    the running sums of that order give the level, so nothing is iterated. It works on one row a
    source; the two orders need those rows, and only those, in one task.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weighted = sources.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)).withColumn("cap", F.col("source_size") * float(most))
    everything = Window.partitionBy(F.lit(0))
    by_level = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source")).rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        weighted.withColumn("total", F.least(share * F.sum("source_size").over(everything), F.sum("cap").over(everything)))
        .withColumn("open_w", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(by_level), F.lit(0.0)))
        .withColumn("full", F.coalesce(F.sum("cap").over(by_level), F.lit(0.0)))
        # the level if this source and all later ones are open
        .withColumn("level", (F.col("total") - F.col("full")) / F.col("open_w"))
        .withColumn("opens", F.col("level") * F.col("w") < F.col("cap"))
        .withColumn("level", F.min(F.when(F.col("opens"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(everything)["level"])
    )
    return ranked.select("source", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("w"))).alias("target"))


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on nothing but its arguments."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def _meet(seed: int, level: int) -> Column:
    """Fold a bucket: state holds the surviving fraction and the documents that are settled."""
    item = "struct<row:bigint,size:bigint,x:double>"
    settled = F.lit(None).cast("array<struct<row:bigint,size:bigint,x:double>>")

    def step(state: Column, new: Column) -> Column:
        old = state["open"]
        both = old["x"] + new["x"]
        # the old one gives all it can, or takes all it can
        give = F.least(old["x"], new["size"] - new["x"])
        take = F.least(new["x"], old["size"] - old["x"])
        gives = _uniform(F.lit(seed), F.lit(level), old["row"], new["row"]) * (give + take) < take
        gives = F.when(give + take > 0, gives).otherwise(F.lit(True))
        old_x = F.when(gives, F.when(give == old["x"], F.lit(0.0)).otherwise(old["x"] - give)).otherwise(F.when(take == old["size"] - old["x"], old["size"].cast("double")).otherwise(old["x"] + take))
        new_x = F.when(gives, F.when(give == new["size"] - new["x"], new["size"].cast("double")).otherwise(new["x"] + give)).otherwise(F.when(take == new["x"], F.lit(0.0)).otherwise(new["x"] - take))
        old_done = (old_x == 0) | (old_x == old["size"])
        a = F.struct(old["row"].alias("row"), old["size"].alias("size"), old_x.alias("x"))
        b = F.struct(new["row"].alias("row"), new["size"].alias("size"), F.when(old_done, F.greatest(F.lit(0.0), F.least(new["size"].cast("double"), both - old_x))).otherwise(new_x).alias("x"))
        return F.when(old.isNull(), F.struct(new.alias("open"), state["done"].alias("done"))).otherwise(
            F.struct(F.when(old_done, b).otherwise(a).alias("open"), F.array_append(state["done"], F.when(old_done, a).otherwise(b)).alias("done"))
        )

    start = F.struct(F.lit(None).cast(item).alias("open"), F.coalesce(settled, F.array().cast(f"array<{item}>")).alias("done"))
    return F.aggregate(F.array_sort("items"), start, step)


def numbered(rows: DataFrame) -> DataFrame:
    """The rows and number: equal rows have different ones, from 1.

    Rows are counted by what they hold, which is added up before it is shuffled, and written out again as often as
    they came, in pieces: however many are equal, no task gets them all.
    """
    names = rows.columns
    counted = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    pieces = counted.withColumn("_first", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n"), F.lit(PIECE).cast("bigint"))))
    # a row is one piece; those of many equal rows are dealt out
    dealt = pieces.repartition(*names, "_first")
    return dealt.select(*names, F.explode(F.sequence("_first", F.least(F.col("_n"), F.col("_first") + PIECE - 1))).alias("number"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken for every row of docs.

    size is the number of words of the text (null: 0); taken = copies * size. Copies are floor or
    ceiling of the source's target over its size, so never more than `most` where that is whole.
    Equal rows are told apart by numbers, which they may swap without any change to the result; other rows
    that share a doc_id differ by text hash or source. Documents of size 0 get
    the whole copies of their source. The same rows always give the same result.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"), F.xxhash64("text").alias("mark"))
    own = materialize(numbered(own), "sizes")
    sources = own.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
    counts = sources.select("source", "source_docs")
    targets = source_targets(sources.select("source", "source_size"), weights, share, most).join(counts.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    targets = materialize(targets, "targets")
    largest = targets.agg(F.max("source_docs").alias("n")).first()["n"] or 0

    keyed = targets.select(F.col("source").alias("_source"), "source_size", "target", "source_docs")
    rows = own.join(keyed, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("whole", F.floor(ratio)).withColumn("x", F.col("size") * (ratio - F.col("whole")))
    rows = materialize(rows.withColumn("row", F.xxhash64("doc_id", "mark", "source", "number")), "fractions")

    open_ = rows.where((F.col("x") > 0) & (F.col("x") < F.col("size"))).select("source", "source_docs", "row", "size", "x")
    done, width, level = [], BUCKET, 0
    while True:
        last = width >= largest
        buckets = F.lit(0) if last else F.pmod(F.xxhash64(F.lit(seed), "row"), F.greatest(F.lit(1), F.ceil(F.col("source_docs") / width)))
        met = open_.groupBy("source", "source_docs", buckets.alias("bucket")).agg(F.collect_list(F.struct("row", "size", "x")).alias("items"))
        met = materialize(met.select("source", "source_docs", _meet(seed, level).alias("m")), "met")
        done.append(met.select("source", F.explode("m.done").alias("d")).select("source", "d.row", "d.x", "d.size"))
        left = met.select("source", "source_docs", "m.open.row", "m.open.size", "m.open.x")
        ended = (F.col("x") <= 0) | (F.col("x") >= F.col("size"))
        if last:
            done.append(left.select("source", "row", F.when(F.col("x") * 2 >= F.col("size"), F.col("size")).otherwise(0).cast("double").alias("x"), "size"))
            break
        done.append(left.where(ended).select("source", "row", "x", "size"))
        open_ = left.where(~ended)
        width *= BUCKET
        level += 1
    chosen = done[0]
    for d in done[1:]:
        chosen = chosen.unionByName(d)
    # two rows of one hash in a source would also have to be of one size to be taken for each other
    extra = chosen.where(F.col("x") * 2 >= F.col("size")).groupBy(F.col("row").alias("_row"), F.col("size").alias("_size"), F.col("source").alias("_source")).agg(F.lit(1).alias("extra"))
    same = (F.col("row") == F.col("_row")) & (F.col("size") == F.col("_size")) & F.col("source").eqNullSafe(F.col("_source"))
    return rows.join(extra, same, "left").select(
        "doc_id", "size", "source_size", "target", (F.col("whole") + F.coalesce("extra", F.lit(0))).cast("bigint").alias("copies"), ((F.col("whole") + F.coalesce("extra", F.lit(0))) * F.col("size")).cast("bigint").alias("taken"), "source", "mark"
    )
