"""Grouped prefix join of documents on the Jaccard similarity of their word n-grams.

A document is the set of its distinct n-gram hashes; equal sets are one entry. Under any fixed order
of the n-grams, two sets that are similar enough have at least l entries in common among their first
|x| - ceil(t |x|) + l. Such prefixes, by order of the hash, are what is shuffled: entries of equal
prefix and size are one group, every prefix n-gram is counted over all groups, and each group then
keeps all but the l - 1 most frequent ones of its prefix. Two similar sets still share one of what is
kept, and for most documents all of that is theirs alone, however often phrases and passages recur.
Groups that share a kept n-gram form clusters; in one of bounded size the groups expand into their
members, which are filtered by size and by the places of their common n-grams and verified on the whole
sets, in one task. A larger cluster is settled in three steps, the last two for members of different
classes only: parts of it with some hubs that all parts get; pairs of groups that share a kept n-gram
few have, filtered by size; and, for n-grams that many have, those outside the largest class against
all. Only links that join two classes are kept, so many near copies cost links in proportion to
their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.wordbatch import Words, mix, rolling, signed, slices
from millrace.operators.graph import connected_components
from millrace.session import materialize

#: how many of the most frequent n-grams move to the end of the order, and from which count on: they
#: needn't be shuffled then. Any order gives the same links, so this bounds what tasks are sent and
#: nothing else.
FREQUENT_MOST = 1 << 16
FREQUENT_FROM = 64
#: bits of the set that tells which texts a later join needs (8 MB)
FILTER_BITS = 1 << 26
#: entries that are compared in one task; larger clusters are settled in steps
BLOCK = 4096
#: entries of a large cluster that each part of it is compared with
HUBS = 8
#: entries with a kept n-gram up to which pairs of their groups are listed
BUCKET = 64


def prefix_length(size: np.ndarray, percent: int) -> np.ndarray:
    return size - (size * percent + 99) // 100 + 1


def spare(size: np.ndarray, percent: int) -> np.ndarray:
    """l - 1: by how much a prefix is longer than it must be; it grows with the size of the set."""
    return (prefix_length(size, percent) - 1) // 2


def ngram_sets(column, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-gram hashes of each text, ascending, and where each text's begin.

    A-Z count as a-z. A text with fewer than n words has one entry, its words; without words, none.
    """
    words = Words(column, lower=True)
    h, counts = words.hashes(), words.counts
    grams = rolling(h, n)
    doc = words.doc
    ok = doc[: len(grams)] == doc[n - 1 :] if len(grams) else np.zeros(0, bool)
    keys, text = grams[ok], doc[: len(grams)][ok]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        total = np.zeros(len(h) + 1, np.uint64)
        place = np.arange(len(h)) - words.of[doc]
        np.cumsum(mix(h + mix(place.astype(np.uint64))), out=total[1:])
        keys = np.append(keys, mix(total[words.of[short + 1]] - total[words.of[short]] + counts[short].astype(np.uint64)))
        text = np.append(text, short)
    order = np.lexsort((keys, text))
    keys, text = keys[order], text[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])
    keys, text = keys[new], text[new]
    return keys, np.searchsorted(text, np.arange(words.n_docs + 1))


def set_hash(keys: np.ndarray, at: np.ndarray, salt: int) -> np.ndarray:
    """A hash of each set that doesn't depend on the order of its entries."""
    total = np.zeros(len(keys) + 1, np.uint64)
    np.cumsum(mix(keys + np.uint64(salt)), out=total[1:])
    return mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64))


def prefixes(keys: np.ndarray, at: np.ndarray, percent: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The long prefix of each set, the most frequent n-grams of all last, and where each one begins."""
    size = np.diff(at)
    text = np.repeat(np.arange(len(size)), size)
    if len(frequent):
        spot = np.minimum(np.searchsorted(frequent, keys), len(frequent) - 1)
        keys = keys[np.lexsort((keys, frequent[spot] == keys, text))]
    place = np.arange(len(keys)) - np.repeat(at[:-1], size)
    p = np.where(size > 0, prefix_length(size, percent) + spare(size, percent), 0)
    return keys[place < np.repeat(p, size)], np.append(0, np.cumsum(p))


def _prefix_tokens(docs: DataFrame, n: int, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            keys, _ = prefixes(*ngram_sets(part.column("text"), n), percent, np.zeros(0, np.uint64))
            token, count = np.unique(keys, return_counts=True)
            # what one slice has once is not among the most frequent of all slices
            token, count = token[count > 1], count[count > 1]
            yield pa.RecordBatch.from_arrays([pa.array(signed(token)), pa.array(count.astype(np.int64))], ["token", "n"])

    return docs.select("text").mapInArrow(run, "token bigint, n bigint")


def _entries(docs: DataFrame, n: int, percent: int, frequent: np.ndarray, with_prefix: bool) -> DataFrame:
    """doc_id, size, the set (two hashes), its group and, if asked for, its prefix, of every row.

    frequent n-grams come last; where a set has enough others, its prefix leaves them out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            keys, at = ngram_sets(part.column("text"), n)
            tokens, starts = prefixes(keys, at, percent, sent.value)
            size = np.diff(at)
            group = mix(set_hash(tokens, starts, 3) + size.astype(np.uint64))
            columns = [part.column("doc_id"), pa.array(size), pa.array(signed(set_hash(keys, at, 1))), pa.array(signed(set_hash(keys, at, 2))), pa.array(signed(group))]
            if with_prefix:
                columns.append(pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(signed(tokens))))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "size", "set1", "set2", "group"] + ["prefix"] * with_prefix)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, size bigint, set1 bigint, set2 bigint, group bigint" + ", prefix array<bigint>" * with_prefix)


def bit_set(rows: DataFrame, spot: str | Column, bits: int = FILTER_BITS) -> np.ndarray:
    """A set of fixed size with a bit for each value of an integer column, by the value's low bits."""
    at = (F.col(spot) if isinstance(spot, str) else spot).bitwiseAND(F.lit(bits - 1))
    words = rows.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    found = words.toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return table


def only_ids(docs: DataFrame, ids: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """doc_id and text of the rows of docs whose doc_id may be one of ids: nearly no others, and none missing.

    The ids become a bit set of fixed size, which is what tasks are sent; a join on doc_id, of much
    fewer texts, is to follow.
    """
    spot = F.xxhash64("doc_id").bitwiseAND(F.lit(bits - 1))
    table = bit_set(ids, F.xxhash64("doc_id"), bits)
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("spot").to_numpy()
            keep = (sent.value[at >> 6] >> (at & 63)) & 1
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text")], ["doc_id", "text"]).filter(pa.array(keep.astype(bool)))

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id IS NOT NULL").withColumn("spot", spot).mapInArrow(run, "doc_id bigint, text string")


class _Classes:
    """Union-find over the entries of one block; a class is named by its least entry."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def block_links(sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join the classes of one block. side: 0 and 1 are compared with each other, 2 with all.

    Prefixes are taken anew, by how often an n-gram occurs in the block.
    """
    token, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    prefix = []
    for own in np.split(inverse, np.cumsum([len(x) for x in sets])[:-1]):
        own = own[np.lexsort((own, count[own]))]
        prefix.append(own[: int(prefix_length(np.int64(len(own)), percent))])
    size = np.array([len(x) for x in sets])
    groups: dict[tuple, list[int]] = {}
    for e in range(len(sets)):
        groups.setdefault((len(sets[e]), prefix[e].tobytes()), []).append(e)
    members = list(groups.values())
    leader = [m[0] for m in members]
    classes, links = _Classes(len(sets)), []
    apart = not (side == 2).all()

    def verify(a: int, b: int) -> bool:
        if apart and side[a] == side[b] != 2:
            return False
        x, y = sets[a], sets[b]
        both = len(np.intersect1d(x, y, assume_unique=True))
        if 100 * both < percent * (len(x) + len(y) - both):
            return False
        classes.join(a, b)
        links.append((a, b))
        return True

    def by_class(group: list[int]) -> list[list[int]]:
        parts: dict[int, list[int]] = {}
        for e in group:
            parts.setdefault(classes.find(e), []).append(e)
        return list(parts.values())

    def meet(a: int, parts: list[list[int]]) -> None:
        """Compare a with the members of each class until one links it to the class."""
        for part in parts:
            if classes.find(a) != classes.find(part[0]):
                any(verify(a, b) for b in part)

    for m in members:
        parts: list[list[int]] = []
        for a in m:
            meet(a, parts)
            own = [part for part in parts if classes.find(part[0]) == classes.find(a)]
            parts = [part for part in parts if classes.find(part[0]) != classes.find(a)]
            parts.append([b for part in own for b in part] + [a])
    # groups by ascending size; each meets the earlier ones that hold one of its prefix n-grams
    order = sorted(range(len(members)), key=lambda g: size[leader[g]])
    index: dict[int, list[tuple[int, int]]] = {}
    for g in order:
        n, tokens = int(size[leader[g]]), prefix[leader[g]].tolist()
        seen: set[int] = set()
        for i, token in enumerate(tokens):
            earlier = index.setdefault(token, [])
            for h, j in earlier:
                m = int(size[leader[h]])
                if h in seen or 100 * m < percent * n:
                    continue
                most = 1 + min(n - i - 1, m - j - 1)
                if 100 * most < percent * (n + m - most):
                    continue
                seen.add(h)
                parts = by_class(members[h])
                for a in members[g]:
                    meet(a, parts)
            earlier.append((g, i))
    return links


def _verified(blocks: DataFrame, percent: int) -> DataFrame:
    """src, dst of the links in each block (cluster, a, b) of rows node, side, keys."""

    def links(rows: list[tuple]) -> list[tuple[int, int]]:
        rows.sort(key=lambda r: r[0])
        return [(rows[a][0], rows[b][0]) for a, b in block_links([r[2] for r in rows], np.array([r[1] for r in rows]), percent)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def out(found):
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["src", "dst"])

        for batch in batches:
            done = []
            lists = batch.column("keys")
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
            for i, (cluster, a, b, node, side) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("cluster", "a", "b", "node", "side")), strict=True)):
                if (cluster, a, b) != key:
                    if len(rows) > 1:
                        done += links(rows)
                    key, rows = (cluster, a, b), []
                rows.append((node, side, flat[at[i] : at[i + 1]].copy()))
            yield out(done)
        yield out(links(rows) if len(rows) > 1 else [])

    blocks = blocks.select("cluster", "a", "b", "node", "side", "keys").repartition("cluster", "a", "b").sortWithinPartitions("cluster", "a", "b")
    return blocks.mapInArrow(run, "src bigint, dst bigint")


def _set_rows(docs: DataFrame, n: int) -> DataFrame:
    """node, cluster and the whole set, for the row of each entry whose set is the entry's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            keys, at = ngram_sets(part.column("text"), n)
            same = (signed(set_hash(keys, at, 1)) == part.column("set1").to_numpy()) & (signed(set_hash(keys, at, 2)) == part.column("set2").to_numpy())
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(signed(keys)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("cluster"), lists], ["node", "cluster", "keys"]).filter(pa.array(same))

    return docs.mapInArrow(run, "node bigint, cluster bigint, keys array<bigint>")


def _pairs_of(own: Column, first: Column, last: Column) -> Column:
    """The pairs of a part with those from first to last, and on which side of each pair it is."""
    return F.transform(F.sequence(first, last), lambda j: F.struct(F.least(own, j).alias("a"), F.greatest(own, j).alias("b"), F.when(own == j, 2).otherwise((own > j).cast("int")).alias("side")))


def _large_links(sets: DataFrame, members: DataFrame, index: DataFrame, percent: int) -> DataFrame:
    """Links that join the classes of the clusters of more than BLOCK entries.

    sets: node, cluster, keys; members: node, cluster, group, n (entries of the cluster), peers (those of
    the group); index: group, size, token. Each set is sent to one part, to each small bucket's pairs
    that are still of two classes, and, outside the largest class of what shares frequent n-grams, to
    the blocks of all others there. Work is thus in proportion to the cluster, but for entries that
    share n-grams with more than BUCKET others and link with few: they are compared block by block.
    """
    none = F.lit(0)
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    # a group stays together if a part can hold it
    own = F.pmod(F.when(F.col("peers") > BLOCK, F.xxhash64("node")).otherwise(F.xxhash64("group")), parts).cast("int")
    members = materialize(members.select("node", "cluster", "group", "peers", parts.alias("parts"), own.alias("own")), "large-members")
    hubs = members.where(F.col("own") < HUBS).groupBy("cluster", "own", "parts").agg(F.min("node").alias("node"))
    others = F.filter(F.sequence(none, F.col("parts") - 1), lambda j: j != F.col("own"))
    spots = members.select("node", "own").union(hubs.select("node", F.explode(others)))
    first = sets.join(spots, "node").select("cluster", F.col("own").alias("a"), F.col("own").alias("b"), "node", F.lit(2).alias("side"), "keys")
    links = materialize(_verified(first, percent), "links-of-parts")

    def classed() -> DataFrame:
        found = members.join(connected_components(links), "node", "left")
        return materialize(found.select("node", "group", F.coalesce("component", "node").alias("class")), "classes")

    known = classed()
    groups = members.select("group", "peers").distinct()
    weighed = index.join(groups, "group")
    weighed = materialize(weighed.join(weighed.groupBy("token").agg(F.sum("peers").alias("weight")), "token"), "buckets")
    few = weighed.where(F.col("weight") <= BUCKET).select("token", "group", "size")
    to = few.select("token", F.col("group").alias("to"), F.col("size").alias("to_size"))
    near = 100 * F.least("size", "to_size") >= percent * F.greatest("size", "to_size")
    pairs = few.join(to, "token").where((F.col("group") < F.col("to")) & near).select("group", "to").distinct()
    ends = known.select(F.col("group").alias("to"), F.col("node").alias("to_node"), F.col("class").alias("to_class"))
    pairs = materialize(pairs.join(known, "group").join(ends, "to").where("class <> to_class").select("node", "to_node").distinct(), "pairs")
    stars = pairs.select(F.col("node").alias("centre"), F.col("to_node").alias("node"), F.lit(1).alias("side")).union(pairs.select("node", "node", none).distinct())
    second = sets.select("node", "keys").join(stars, "node").select(F.col("centre").alias("cluster"), none.alias("a"), none.alias("b"), "node", "side", "keys")
    links = links.union(materialize(_verified(second, percent), "links-of-pairs"))

    many = weighed.where(F.col("weight") > BUCKET)
    least = many.groupBy("token").agg(F.min("group").alias("least"))
    edges = many.join(least, "token").select(F.col("group").alias("src"), F.col("least").alias("dst")).where("src <> dst").distinct()
    families = connected_components(edges).select(F.col("node").alias("group"), "component")
    hot = many.select("group").union(groups.where(F.col("peers") > BLOCK).select("group")).distinct()
    hot = hot.join(families, "group", "left").select("group", F.coalesce("component", "group").alias("family"))
    at = materialize(classed().join(hot, "group").select("node", "class", "family"), "hot-entries")
    sizes = at.groupBy("family", "class").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("family").agg(F.max(F.struct("n", "class")).alias("main"), F.sum("n").alias("n")).where("n > main.n")
    block_count = lambda n: F.ceil(n / BLOCK).cast("int")
    largest = largest.select("family", F.col("main.class").alias("main"), block_count(F.col("n") - F.col("main.n")).alias("rest"), block_count(F.col("main.n")).alias("mains"))
    at = at.join(largest, "family").withColumn("outside", F.col("class") != F.col("main"))
    spot = F.when(F.col("outside"), F.pmod(F.xxhash64("node"), "rest")).otherwise(F.col("rest") + F.pmod(F.xxhash64("node"), "mains")).cast("int")
    last = F.when(F.col("outside"), F.col("rest") + F.col("mains")).otherwise(F.col("rest")) - 1
    at = at.withColumn("own", spot).select("node", "family", F.explode(_pairs_of(F.col("own"), none, last)).alias("pair"))
    third = sets.select("node", "keys").join(at, "node").select(F.col("family").alias("cluster"), "pair.a", "pair.b", "node", "pair.side", "keys")
    return links.union(materialize(_verified(third, percent), "links-of-blocks"))


def ngram_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs.

    Two documents link when 100 * |intersection| >= percent * |union| of their distinct lower-cased
    word n-grams; component_id is the least doc_id that links reach. Documents without words (also
    null texts) link with nothing. doc_id names a document: rows that share one are one node and so
    share what either links to. A row without a doc_id takes part in nothing and gets null.
    """
    counts = _prefix_tokens(docs, n, percent).groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT_FROM)
    frequent = np.sort(np.array([r["token"] for r in counts.orderBy(F.desc("n"), "token").limit(FREQUENT_MOST).select("token").collect()], np.int64).view(np.uint64))
    entries = materialize(_entries(docs, n, percent, frequent, False), "entries")
    known = entries.where("doc_id IS NOT NULL AND size > 0")
    # equal sets are one entry, named by its least doc_id
    sets = materialize(known.groupBy("set1", "set2").agg(F.min("doc_id").alias("node"), F.first("size").alias("size"), F.first("group").alias("group")), "sets")

    # n-grams of the groups' prefixes that more than one group has
    groups = _entries(docs, n, percent, frequent, True).where("doc_id IS NOT NULL AND size > 0").groupBy("group").agg(F.first("size").alias("size"), F.first("prefix").alias("prefix"))
    tokens = groups.select("group", "size", F.posexplode("prefix").alias("place", "token"))
    tokens = materialize(tokens.select("group", "size", "token"), "prefix-ngrams")
    # counted before they are shuffled; the join back is one that adaptive execution may split
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialize(tokens.join(often, "token").select("group", "size", "token", "n"), "shared-ngrams")
    length = lambda size: size - F.floor((size * percent + 99) / 100) + 1
    extra = lambda size: F.floor((length(size) - 1) / 2)
    # a partner may be smaller, so its prefix promises less: drop what the smallest one allows
    least_partner = F.floor((F.col("size") * percent + 99) / 100)
    kept = length(F.col("size")) + extra(F.col("size")) - extra(least_partner)
    alone = length(F.col("size")) + extra(F.col("size")) - F.count(F.lit(1)).over(Window.partitionBy("group"))
    rank = F.row_number().over(Window.partitionBy("group").orderBy("n", "token"))
    index = shared.withColumn("rank", rank).withColumn("alone", alone).where(F.col("rank") + F.col("alone") <= kept).select("group", "size", "token")
    index = materialize(index, "index")
    least = index.groupBy("token").agg(F.min("group").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("token", "least")
    edges = index.join(least, "token").select(F.col("group").alias("src"), F.col("least").alias("dst")).where("src <> dst").distinct()
    clusters = materialize(connected_components(edges), "clusters").select(F.col("node").alias("group"), "component")
    placed = sets.join(clusters, "group", "left").select("node", "set1", "set2", "group", F.coalesce("component", "group").alias("cluster"))
    sizes = placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    needed = materialize(placed.join(sizes, "cluster").withColumnRenamed("node", "doc_id"), "needed")

    def whole_sets(of: DataFrame) -> DataFrame:
        return _set_rows(only_ids(docs, of).join(of.select("doc_id", "set1", "set2", "cluster"), "doc_id"), n)

    alone = whole_sets(needed.where(F.col("n") <= BLOCK)).withColumns({"a": F.lit(0), "b": F.lit(0), "side": F.lit(2)})
    links = materialize(_verified(alone, percent), "verified")
    large = needed.where(F.col("n") > BLOCK)
    if not large.isEmpty():
        peers = large.groupBy("group").agg(F.count(F.lit(1)).alias("peers"))
        members = large.join(peers, "group").select(F.col("doc_id").alias("node"), "cluster", "group", "n", "peers")
        links = links.union(_large_links(materialize(whole_sets(large), "large-sets"), members, index, percent))
    # several sets under one doc_id are one document
    shared = known.select("doc_id", "set1", "set2").join(sets.select("set1", "set2", "node"), ["set1", "set2"])
    shared = shared.where("doc_id <> node").groupBy("doc_id", "node").agg(F.lit(1).alias("_"))
    twice = known.groupBy("doc_id").agg(F.count_distinct("set1", "set2").alias("n")).where("n > 1").select("doc_id")
    also = shared.join(twice, "doc_id", "left_semi").select(F.col("doc_id").alias("src"), F.col("node").alias("dst"))
    classes = connected_components(links.union(also))
    named = sets.select("set1", "set2", "node").join(classes, "node", "left").select("set1", "set2", F.coalesce("component", "node").alias("class"))
    return entries.join(named, ["set1", "set2"], "left").select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("class", "doc_id")).alias("component_id"))
