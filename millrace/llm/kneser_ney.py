"""A quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is of characters as they stand (any script, case kept), ORDER in a row and so across the
ends of words. Its n-grams are counted over all trusted text, added up in each task before they are
shuffled. Counts, continuation counts, discounts, probabilities and left-over shares are tables that
are sharded by n-gram and grow with the text; neither a task nor the driver holds them.

A document's log probability is a sum over its places. The FREQUENT n-grams of the largest counts, a
number that doesn't depend on the corpus, are sent to all tasks and serve nearly all places there. The
n-grams of all other places are counted by document and joined with the sharded table, which gives
exactly what the frequent ones leave out. The perplexity is held against a quantile, per language, of
the perplexities of trusted documents that the model was not trained on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.ngram_join import bit_set, only_ids
from millrace.llm.toxicity import held_out
from millrace.llm.wordbatch import U, mix, signed, slices, text_bytes
from millrace.session import materialize

#: characters of the longest n-grams
ORDER = 5
#: how many n-grams tasks are sent, at most; it bounds memory and changes no result
FREQUENT = 1 << 19
QUANTILE = 0.995
#: trusted documents of a language below which the quantile of all languages holds
LEAST_DOCS = 30
#: code points that there are: what no text has shares evenly
POINTS = 0x110000
_STEP = U(0x9FB21C651E98DF25)


class Places:
    """The characters of texts, text by text, each after ORDER - 1 line feeds and before one."""

    def __init__(self, column):
        data, at = text_bytes(column)
        n = len(at) - 1
        self.data = np.insert(data, np.concatenate([np.repeat(at[:-1], ORDER - 1), at[1:]]), 10)
        at = at + ORDER * np.arange(n + 1)
        self.char = np.flatnonzero((self.data & 0xC0) != 0x80)
        self.points = np.frombuffer(self.data.tobytes().decode().encode("utf-32-le"), np.uint32)
        char_at = np.searchsorted(self.char, at)
        self.n_chars = np.diff(char_at) - ORDER
        text = np.repeat(np.arange(n), np.diff(char_at))
        #: the places that are predicted (a text's characters and the line feed after it), and their texts
        self.event = np.flatnonzero(np.arange(len(text)) - char_at[text] >= ORDER - 1)
        self.text = text[self.event]

    def keys(self, k: int, at: np.ndarray) -> np.ndarray:
        """A hash of the k characters up to each place."""
        out = np.zeros(len(at), np.uint64)
        for before in range(k - 1, -1, -1):
            out *= _STEP
            out += self.points[at - before]
        return mix(out + U(k << 56))

    def strings(self, at: np.ndarray, k: int = ORDER) -> pa.Array:
        """The k characters up to each place."""
        begin, end = self.char[at - k + 1], np.append(self.char, len(self.data))[at + 1]
        length = end - begin
        to = np.append(0, np.cumsum(length))
        index = np.arange(to[-1]) + np.repeat(begin - to[:-1], length)
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(to.astype(np.int32)), pa.py_buffer(self.data[index]))


def gram_counts(texts: DataFrame) -> DataFrame:
    """gram, n: the counts of all n-grams of ORDER characters in a table of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=1 << 20):
            places = Places(part.column("text"))
            _, one, n = np.unique(places.keys(ORDER, places.event), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([places.strings(places.event[one]), pa.array(n.astype(np.int64))], ["gram", "n"])

    return texts.select("text").mapInArrow(run, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> list[float]:
    seen = {r["n"]: r["k"] for r in counts.where("n <= 4").groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()}
    n1, n2, n3, n4 = (seen.get(i, 0) for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    return [min(max(i - (i + 1) * y * b / a, 0.1), i - 0.05) if a and b else 0.5 * i**0.5 for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]


def _suffix() -> Column:
    return F.expr("substring(gram, 2)")


def kneser_ney(counts: DataFrame) -> DataFrame:
    """gram, n, logp, value, rest: all n-grams of orders 1 to ORDER, and the contexts among them.

    counts are of the highest order; each lower order counts in how many different contexts its
    n-grams were seen, and discounts follow from how many n-grams have counts 1 to 4. logp is of the
    last character after the others, interpolated with all lower orders; rest, of an n-gram as a
    context, the log of what it leaves to the lower order. value is logp less what it would be if the
    n-gram hadn't been seen. A gram of no characters stands for the context of order 1.
    """
    tables = [counts.select("gram", "n")]
    for _ in range(1, ORDER):
        tables.append(materialize(tables[-1].groupBy(_suffix().alias("gram")).agg(F.count(F.lit(1)).alias("n")), "kn-counts"))
    tables.reverse()
    parts, lower = [], None
    for order, table in enumerate(tables, 1):
        d = _discounts(table)
        discount = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        context = F.expr(f"left(gram, {order - 1})")
        contexts = table.groupBy(context.alias("context")).agg(F.sum("n").alias("total"), F.sum(discount).alias("held"))
        own = table.select("gram", "n", context.alias("context"), (F.col("n") - discount).alias("share")).join(contexts, "context")
        if lower is None:
            own = own.withColumn("below", F.lit(1.0 / POINTS))
        else:
            own = own.join(lower.select(F.col("gram").alias("suffix"), F.exp("logp").alias("below")), _suffix() == F.col("suffix"))
        rest = F.col("held") / F.col("total")
        p = F.col("share") / F.col("total") + rest * F.col("below")
        lower = materialize(own.select("gram", "n", F.log(p).alias("logp"), F.log(p / (rest * F.col("below"))).alias("value")), "kn-model")
        parts += [lower.withColumn("rest", F.lit(None).cast("double")), contexts.select(F.col("context").alias("gram"), *[F.lit(None).cast(t).alias(c) for c, t in (("n", "bigint"), ("logp", "double"), ("value", "double"))], F.log(rest).alias("rest"))]
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.unionByName(x)
    return rows.groupBy("gram").agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), *[F.max(c).alias(c) for c in ("logp", "value", "rest")])


def _hashed(model: DataFrame) -> DataFrame:
    """The model with the key of each n-gram, as Places has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = Places(batch.column("gram"))
            last = np.cumsum(places.n_chars + ORDER) - 2
            key = np.zeros(len(last), np.uint64)
            for k in range(1, ORDER + 1):
                own = np.flatnonzero(places.n_chars == k)
                key[own] = places.keys(k, last[own])
            yield pa.RecordBatch.from_arrays([pa.array(signed(key)), *(batch.column(c) for c in ("n", "logp", "value", "rest"))], ["key", "n", "logp", "value", "rest"])

    return model.mapInArrow(run, "key bigint, n bigint, logp double, value double, rest double")


class Frequent:
    """The n-grams that tasks hold, by open addressing: their logp and rest."""

    def __init__(self, keys: np.ndarray, logp: np.ndarray, rest: np.ndarray):
        size = 1 << max(4, (2 * len(keys)).bit_length())
        self.mask = U(size - 1)
        self.key, self.logp, self.rest = np.zeros(size, np.uint64), np.full(size, np.nan, np.float32), np.zeros(size, np.float32)
        todo, slot = np.arange(len(keys)), keys & self.mask
        while len(todo):
            free = todo[self.key[slot[todo]] == 0]
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.key[slot[put]], self.logp[slot[put]], self.rest[slot[put]] = keys[put], logp[put], rest[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            slot[todo] = (slot[todo] + U(1)) & self.mask

    def find(self, key: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1."""
        slot = (key & self.mask).astype(np.int64)
        now = self.key[slot]
        out = np.where(now == key, slot, -1)
        todo = np.flatnonzero((now != key) & (now != 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & int(self.mask)
            now = self.key[slot[todo]]
            same = now == key[todo]
            out[todo[same]] = slot[todo[same]]
            todo = todo[~same & (now != 0)]
        return out


class Model:
    """What tasks are sent to score texts, and the sharded table of all that is not in it."""

    def __init__(self, counts: DataFrame, frequent: int = FREQUENT):
        model = kneser_ney(counts)
        self.unseen = (model.where("gram = ''").agg(F.max("rest")).first()[0] or 0.0) - math.log(POINTS)
        hashed = materialize(_hashed(model.where("gram <> ''")), "kn-hashed")
        # by how often they come: the least of the largest counts that together are few enough
        level = F.floor(F.log2(F.greatest("n", F.lit(1))) * 32)
        total, least = 0, 1 << 20
        for r in hashed.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("level")).collect():
            total += r["n"]
            if total > frequent:
                break
            least = r["level"]
        top = hashed.where(level >= least).select("key", F.coalesce("logp", F.lit(float("nan"))).alias("logp"), F.coalesce("rest", F.lit(0.0)).alias("rest")).toArrow()
        self.top = Frequent(top.column("key").to_numpy().astype(np.int64).view(np.uint64), top.column("logp").to_numpy(), top.column("rest").to_numpy())
        self.other = hashed.where(level < least).select("key", "value", "rest")
        self.bits = bit_set(self.other.select("key"), "key")


def _requests(places: Places, top: Frequent, bits: np.ndarray, unseen: float):
    """log p of each place by the frequent n-grams, as if there were no others; and what may be missing.

    What may be missing: texts, keys, and whether a key is asked for as a context.
    """
    logp = np.zeros(len(places.event))
    asked: list[tuple[np.ndarray, np.ndarray, bool]] = []

    def ask(which: np.ndarray, key: np.ndarray, context: bool) -> None:
        spot = (key & U(len(bits) * 64 - 1)).astype(np.int64)
        some = np.flatnonzero((bits[spot >> 6] >> (spot & 63)) & 1)
        asked.append((places.text[which[some]], key[some], context))

    open_ = np.arange(len(places.event))
    for k in range(ORDER, 0, -1):
        key = places.keys(k, places.event[open_])
        slot = top.find(key)
        own = top.logp[slot]
        hit = (slot >= 0) & ~np.isnan(own)
        logp[open_[hit]] += own[hit]
        open_, key = open_[~hit], key[~hit]
        if not len(open_):
            break
        ask(open_, key, False)
        if k == 1:
            logp[open_] += unseen
        else:
            key = places.keys(k - 1, places.event[open_] - 1)
            slot = top.find(key)
            logp[open_] += np.where(slot >= 0, top.rest[slot], 0)
            ask(open_[slot < 0], key[slot < 0], True)
    return logp, asked


def perplexities(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang, n_chars, perplexity (per character and end; null for an empty text) of every row.

    Rows are followed by a hash of their text, which is all that the perplexity depends on: the sum
    over equal texts is divided by their number.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.top, model.bits, model.unseen))
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("lang").cast("string"), F.col("text").cast("string"), F.xxhash64(F.col("text").cast("string")).alias("row"))

    def base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            places = Places(part.column("text"))
            logp, _ = _requests(places, *sent.value)
            total = np.bincount(places.text, logp, part.num_rows)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "lang", "row")), pa.array(places.n_chars.astype(np.int64)), pa.array(total)], ["doc_id", "lang", "row", "n_chars", "base"])

    def missing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            _, asked = _requests(Places(part.column("text")), *sent.value)
            row = part.column("row").to_numpy()
            for context in (False, True):
                text, key = (np.concatenate([a[i] for a in asked if a[2] is context] or [np.zeros(0, t)]) for i, t in ((0, np.int64), (1, np.uint64)))
                _, one, n = np.unique(mix(key + text.astype(np.uint64) * _STEP), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(row[text[one]]), pa.array(signed(key[one])), pa.array(np.full(len(one), context)), pa.array(n.astype(np.int32))], ["row", "key", "context", "n"])

    rows = materialize(docs.mapInArrow(base, "doc_id bigint, lang string, row bigint, n_chars bigint, base double"), "scored")
    asked = docs.select("row", "text").mapInArrow(missing, "row bigint, key bigint, context boolean, n int")
    gain = F.coalesce(F.when(F.col("context"), F.col("rest")).otherwise(F.col("value")), F.lit(0.0))
    sums = asked.join(model.other.hint("merge"), "key").groupBy("row").agg(F.sum(F.col("n") * gain).alias("sum"))
    equal = rows.groupBy("row").agg(F.count(F.lit(1)).alias("equal"))
    each = equal.join(sums, "row", "left").select("row", (F.coalesce("sum", F.lit(0.0)) / F.col("equal")).alias("more"))
    mean = -(F.col("base") + F.col("more")) / (F.col("n_chars") + 1)
    return rows.join(each, "row").select("doc_id", "lang", "n_chars", F.when(F.col("n_chars") > 0, F.exp(mean)).alias("perplexity"))


def quality(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, n_chars, perplexity, threshold, kept of every row of docs.

    trusted lists the doc_ids of trusted documents. Those that are not held out train the model; the
    quantile of the others' perplexities is the threshold of their language. Languages of fewer than
    LEAST_DOCS such documents, and rows without a language, have the quantile of all. An empty text
    has no perplexity and is not kept; without trusted text nothing is rejected but empty texts. Rows
    without a doc_id are scored but not trusted; rows that share one are trusted together. Columns of
    docs beyond doc_id, text and lang are not read; an empty table gives an empty one.
    """
    ids = materialize(trusted.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct(), "trusted")
    train = ids.where(~held_out(F.col("doc_id")))
    # a merge join at any size: what is shuffled then grows with the trusted text, without a jump
    texts = only_ids(docs, train).join(train.hint("merge"), "doc_id", "left_semi").select("text")
    model = Model(materialize(gram_counts(texts), "kn-counts"))
    scored = materialize(perplexities(docs, model), "perplexities")
    trial = scored.where("perplexity IS NOT NULL").join(ids.where(held_out(F.col("doc_id"))), "doc_id", "left_semi")
    cut = F.percentile_approx("perplexity", quantile, 10_000)
    everywhere = trial.agg(cut.alias("t")).first()["t"]
    limits = trial.groupBy("lang").agg(cut.alias("t"), F.count(F.lit(1)).alias("n")).where((F.col("n") >= LEAST_DOCS) & F.col("lang").isNotNull()).select("lang", "t")
    threshold = F.coalesce("t", F.lit(everywhere).cast("double"), F.lit(float("inf")))
    found = scored.join(limits, "lang", "left").withColumn("threshold", threshold)
    return found.select("doc_id", "lang", "n_chars", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)).alias("kept"))
