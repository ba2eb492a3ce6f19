"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

A text is a weighted set: its words, each as heavy as it is frequent. Sample j draws for each word,
from a hash of the word and j alone, r and c of a Gamma(2, 1) distribution and b uniform in [0, 1),
and sets t = floor(ln(w) / r + b) and ln a = ln c - r (t - b + 1); the word of the least a, with its
t, is the sample (Ioffe 2010). Two texts agree in a sample with a probability equal to the
generalised Jaccard similarity of their word counts, sum(min) / sum(max), so the share of equal
samples estimates it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import materialize

SAMPLES = 32
#: doc_ids of one block (a power of two): a document's neighbours are found inside its block
BLOCK_BITS = 8
#: blocks of one group of blocks
GROUP_BITS = 12
_ID_BITS = 20


def _unit(bits: Column, shift: int) -> Column:
    """A number in (0, 1) from 21 bits of a hash."""
    return (F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << 21) - 1)) + F.lit(0.5)) * F.lit(2.0**-21)


def _sample(term: Column, log_weight: Column, j: int) -> Column:
    """ln a in the upper bits and a mark of the word and its t in the lower ones: the least one wins.

    A Gamma(2, 1) number is -ln(u v) of two uniform ones.
    """
    one, two = F.xxhash64(F.lit(2 * j), term), F.xxhash64(F.lit(2 * j + 1), term)
    r = -F.ln(_unit(one, 0) * _unit(one, 21))
    log_c = F.ln(-F.ln(_unit(two, 0) * _unit(two, 21)))
    b = _unit(one, 42)
    t = F.floor(log_weight / r + b)
    rank = ((log_c - r * (t - b + 1.0) + 128.0) * float(1 << 34)).cast("bigint")
    mark = F.xxhash64(F.lit(j), term, t).bitwiseAND(F.lit((1 << _ID_BITS) - 1))
    return F.shiftleft(rank, _ID_BITS).bitwiseOR(mark)


def weighted_samples(texts: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """keys and marks (array of `samples` numbers; null for a text without words) of each row of texts.

    keys must name a row. The word counts and the least samples are aggregates by keys: where texts
    is already partitioned by some of them, neither shuffles.
    """
    words = F.explode_outer(F.split(F.translate("text", "\t\n\x0b\x0c\r", "     "), " "))
    terms = texts.select(*keys, words.alias("word")).select(*keys, F.when(F.col("word") != "", F.xxhash64("word")).alias("term"))
    counted = terms.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("n"))
    weighed = counted.select(*keys, "term", F.ln(F.col("n").cast("double")).alias("w"))
    # drawn inside the aggregate, whose code Spark compiles function by function
    least = weighed.groupBy(*keys).agg(*[F.min(F.when(F.col("term").isNotNull(), _sample(F.col("term"), F.col("w"), j))).alias(f"s{j}") for j in range(samples)])
    marks = F.array(*[F.col(f"s{j}").bitwiseAND(F.lit((1 << _ID_BITS) - 1)).cast("int") for j in range(samples)])
    return least.select(*keys, F.when(F.col("s0").isNotNull(), marks).alias("marks"))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples; texts without words are like each other and nothing else."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(equal / F.size(a).cast("double"))


def fingerprint(marks: Column) -> Column:
    """Five hex digits for each sample; an empty string for a text without words."""
    return F.coalesce(F.array_join(F.transform(marks, lambda m: F.lpad(F.lower(F.hex(m)), 5, "0")), ""), F.lit(""))


def _block_neighbours(ids: DataFrame) -> DataFrame:
    """For each block of ids: its least and greatest id, and the next block upwards (after the last: the first).

    Found from counts of blocks alone: within groups of blocks by a window, and from group to group
    by a window over one row a group.
    """
    blocks = ids.groupBy("block").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    blocks = blocks.withColumn("group", F.shiftright("block", GROUP_BITS))
    groups = blocks.groupBy("group").agg(F.min("block").alias("first"))
    everything = Window.partitionBy(F.lit(0))
    groups = groups.select("group", F.coalesce(F.lead("first").over(everything.orderBy("group")), F.min("first").over(everything)).alias("next_first"))
    within = F.lead("block").over(Window.partitionBy("group").orderBy("block"))
    return blocks.withColumn("up", within).join(groups, "group").select("block", "low", "high", F.coalesce("up", "next_first").alias("up"))


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of each text and of its edited form, for every row of docs.

    The edited form is the text with its last floor(n / 2) code points replaced by as many of the
    first ones of the next document (all, if there are fewer) in descending order of doc_id; after
    the last comes the first. Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited and near_next. A null text counts as empty, a missing doc_id as
    below all others; rows that share a doc_id follow one another by text. A table of one row is its
    own neighbour; an empty one gives no rows.
    """
    id_ = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)))
    rows = docs.select(id_.alias("id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("block", F.shiftright("id", BLOCK_BITS))
    blocks = _block_neighbours(docs.select(id_.alias("id")).withColumn("block", F.shiftright("id", BLOCK_BITS)))
    blocks = materialize(blocks, "blocks")
    # the first text of each block in descending order is the next one of the last in the block above
    # (>= because an equality would become a key of the join, and the texts be shuffled once more)
    guests = rows.join(blocks.select("block", "high", "up"), "block").where("id >= high").groupBy(F.col("up").alias("block")).agg(F.max("text").alias("guest"))
    g = guests.select(F.col("block").alias("guest_block"), "guest")
    # both uses of met need the same columns, so that they share one shuffle of the texts
    met = rows.join(blocks.select("block", "low"), "block").join(g, (F.col("block") == F.col("guest_block")) & (F.col("id") == F.col("low")), "left")
    order = Window.partitionBy("block").orderBy(F.desc("id"), F.desc("text"))
    ranked = met.select("block", "id", "text", F.row_number().over(order).alias("row"), F.coalesce(F.lead("text").over(order), F.col("guest")).alias("next"))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 2) as int))"), F.expr("left(next, cast(floor(length(text) / 2) as int))"))
    edited = F.when(half > 0, edited).otherwise(F.col("text"))
    pair = ranked.select("block", "row", "id", "text", edited.alias("edited"))
    both = pair.select("block", "row", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("text")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))).alias("t")).select("block", "row", "t.kind", "t.text")
    marks = weighted_samples(both, ["block", "row", "kind"], samples)
    marks = marks.groupBy("block", "row").agg(F.max(F.when(F.col("kind") == 0, F.col("marks"))).alias("marks"), F.max(F.when(F.col("kind") == 1, F.col("marks"))).alias("edited_marks"))
    about = pair.select("block", "row", "id", F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    full = materialize(about.join(marks, ["block", "row"]), "fingerprints")
    # fingerprints of the next documents: in the block, else the first of the block below
    heads = full.where("row = 1").join(blocks.select("block", "up"), "block").select(F.col("up").alias("head_block"), F.col("marks").alias("head_marks"))
    down = Window.partitionBy("block").orderBy("row")
    last = F.lead("row").over(down).isNull()
    full = full.withColumn("last", last).withColumn("next_marks", F.lead("marks").over(down)).join(heads, (F.col("block") == F.col("head_block")) & F.col("last"), "left")
    next_marks = F.when(F.col("last"), F.col("head_marks")).otherwise(F.col("next_marks"))
    return full.select(
        F.when(F.col("id") != -(1 << 63), F.col("id")).alias("doc_id"), "n_chars", "edited_sha256", fingerprint(F.col("marks")).alias("fingerprint"), fingerprint(F.col("edited_marks")).alias("edited_fingerprint"),
        likeness(F.col("marks"), F.col("edited_marks")).alias("near_edited"), likeness(F.col("marks"), next_marks).alias("near_next"),
    )
