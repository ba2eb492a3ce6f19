"""Runs of periodic words: maximal pairs in the tree of LCP intervals of a text.

A maximal pair is two places i < j of a text whose words agree for exactly l words, with neither the word
before nor the word after in common. The words from i to j + l then have period j - i, and no neighbour
extends them: such a stretch is a run of the wanted kind exactly if its distance is short against l, and
nothing has to be extended.

The intervals of common prefixes are visited bottom up. Each has the list of its places in the order of the
text, and each place its class, the word on its left. Where the lists of children meet in an interval, two
places of different children differ in the word after, and a pair of different classes is maximal. Only
neighbours in the joined list are compared: a place between i and j with the same l words would give them
a shorter period, of which j - i were a multiple. So neighbours are exactly the pairs whose distance is the
smallest period, a run is found once, and the pairs of an interval never grow with the square of its size.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.wordbatch import Words, rolling, slices, strings, text_bytes, within

U = np.uint64
MIN_WORDS, TIMES = 6, 4
SPACES = r"[^\x20\x09-\x0D]+"


def repetitive(h: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Which texts have k words in a row more than once; h are the hashes of their words."""
    doc = np.repeat(np.arange(len(counts)), counts)
    grams = rolling(h, k)
    at = np.flatnonzero(within(counts, k, len(grams)))
    key = grams[at] + doc[at].astype(U) * U(0xD6E8FEB86659FD93)
    order = np.argsort(key, kind="stable")
    out = np.zeros(len(counts), bool)
    out[doc[at][order[1:]][key[order][1:] == key[order][:-1]]] = True
    return out


def suffixes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of keys in order, and the common prefix of each with the one before (0 for the first).

    Texts are one after the other, each with an end of its own that comes nowhere else. Ranks of 1, 2, 4...
    keys are doubled; a rank is the place in the order where its group starts, and only places whose group
    has others are sorted again. Common prefixes are read from the ranks of all widths.
    """
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    new = np.ones(n, bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    first = np.flatnonzero(new)
    rank = np.empty(n, np.int32)
    rank[order] = np.repeat(first, np.diff(np.append(first, n)))
    shared = np.repeat(np.diff(np.append(first, n)) > 1, np.diff(np.append(first, n)))
    open_ = order[shared]
    levels, width = [rank], 1
    while len(open_):
        pair = rank[open_].astype(np.int64) << 32 | rank[np.minimum(open_ + width, n - 1)]
        sort = np.argsort(pair, kind="stable")
        open_, pair = open_[sort], pair[sort]
        head = np.ones(len(open_), bool)
        head[1:] = pair[1:] != pair[:-1]
        group = np.ones(len(open_), bool)
        group[1:] = pair[1:] >> 32 != pair[:-1] >> 32
        at = np.arange(len(open_))
        inside = at - np.maximum.accumulate(np.where(group, at, 0))
        start = np.maximum.accumulate(np.where(head, at, 0))
        rank = rank.copy()
        rank[open_] = (pair >> 32) + inside[start]
        levels.append(rank)
        size = np.diff(np.append(np.flatnonzero(head), len(open_)))
        open_ = open_[np.repeat(size > 1, size)]
        width *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    a, b = order[:-1].copy(), order[1:].copy()
    for rank in reversed(levels[:-1]):
        width //= 2
        same = rank[a] == rank[b]
        a[same] += width
        b[same] += width
    lcp = np.zeros(n, np.int64)
    lcp[1:] = a - order[:-1]
    return order, lcp


def short_pairs(places: list[int], lcp: list[int], left: list[int], times: int) -> list[tuple[int, int, int]]:
    """start, length, period of the maximal pairs (i, j, l) with l >= (times - 1) * (j - i), of neighbours in their interval.

    places are suffixes in order, left is the class of each place of the text. Of the lists that meet, all
    but the longest are put into that one, so a place moves at most log2(n) times.
    """
    found: list[tuple[int, int, int]] = []

    def join(children: list[list[int]], depth: int) -> list[int]:
        most, child = depth // (times - 1), {}
        children.sort(key=len)
        whole = children.pop()
        moved = 0
        for k, other in enumerate(children):
            moved += len(other)
            for p in other:
                child[p] = k
        if 8 * moved < len(whole):
            for p in child:
                insort(whole, p)
        else:
            for other in children:
                whole += other
            whole.sort()
        for p, k in child.items():
            x = bisect_left(whole, p)
            if x + 1 < len(whole):
                q = whole[x + 1]
                if q - p <= most and child.get(q) != k and left[p] != left[q]:
                    found.append((p, q - p + depth, q - p))
            # a pair of two moved places is found at the first of them
            if x and (q := whole[x - 1]) not in child and p - q <= most and left[p] != left[q]:
                found.append((q, p - q + depth, p - q))
        return whole

    stack: list[tuple[int, list[list[int]]]] = []
    for p, depth in zip(places, [*lcp[1:], 0], strict=True):
        own = [p]
        while stack and stack[-1][0] > depth:
            level, children = stack.pop()
            children.append(own)
            own = join(children, level)
        if not depth:
            continue
        if stack and stack[-1][0] == depth:
            stack[-1][1].append(own)
        else:
            stack.append((depth, [own]))
    return found


def runs_of(h: np.ndarray, counts: np.ndarray, least: int = MIN_WORDS, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """The runs of each text as start, length, period, in order; h are the hashes of all words, text by text.

    A run has at least `least` words and `times` periods.
    """
    out: list[list[tuple[int, int, int]]] = [[] for _ in counts]
    # the common prefix of a pair: all of the run but one period
    k = min(max(least - q, (times - 1) * q) for q in range(1, least + 1))
    some = repetitive(h, counts, k)
    if not some.any():
        return out
    doc = np.repeat(np.arange(len(counts)), counts)
    inside = some[doc]
    ids = np.unique(h[inside], return_inverse=True)[1].astype(np.int64) + 1
    # each text is followed by its end, which is 0 and its own
    docs = np.flatnonzero(some)
    ends = np.cumsum(counts[docs])
    keys = np.insert(docs[np.repeat(np.arange(len(docs)), counts[docs])] << 32 | ids, ends, docs << 32)
    first = np.cumsum(counts[docs] + 1) - counts[docs] - 1
    order, lcp = suffixes(keys)
    deep = np.zeros(len(lcp) + 1, bool)
    deep[:-1] = lcp >= k
    kept = deep[:-1] | deep[1:]
    left = np.full(len(keys), -1, np.int64)
    left[1:] = keys[:-1]
    left[first] = -1
    pairs = short_pairs(order[kept].tolist(), np.where(lcp >= k, lcp, 0)[kept].tolist(), left.tolist(), times)
    for start, length, period in sorted(pairs, key=lambda r: (r[0], r[2])):
        if length >= least:
            d = int(np.searchsorted(first, start, "right")) - 1
            out[docs[d]].append((start - int(first[d]), length, period))
    return out


RUNS = "n_words bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _rows(batches: Iterable[pa.RecordBatch], least: int, times: int, whole: bool) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "t"):
        words = Words(part.column("t"))
        found = runs_of(words.hashes(), words.counts, least, times)
        data, at = text_bytes(part.column("t"))
        raw = data.tobytes()
        best, digests, collapsed, texts = [], [], [], []
        for d, runs in enumerate(found):
            left = raw[at[d] : at[d + 1]].split()
            if runs:
                gone = np.zeros(len(left) + 1, np.int64)
                for start, length, period in runs:
                    gone[start + period] += 1
                    gone[start + length] -= 1
                left = [left[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]
            top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
            best.append((*top, 1000 * top[1] // top[2] if runs else None))
            digests.append(hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest())
            text = b" ".join(left)
            collapsed.append(hashlib.sha256(text).hexdigest())
            if whole:
                texts.append(text.decode())
        n = part.num_rows
        made = [pa.array(words.counts, pa.int64()), pa.array([len(r) for r in found], pa.int64()), *(pa.array(c, pa.int64()) for c in zip(*best, strict=True)), strings(digests), strings(collapsed)]
        made.append(pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs] for runs in found], pa.list_(RUN)) if whole else pa.nulls(n, pa.list_(RUN)))
        made.append(strings(texts) if whole else pa.nulls(n, pa.string()))
        yield pa.record_batch([part.column("k"), *made], ["k", *(c.split(" ")[0] for c in RUNS.split(", "))])


def periodic_runs(docs: DataFrame, least: int = MIN_WORDS, times: int = TIMES, key: str = "doc_id", text: str = "text", whole: bool = True) -> DataFrame:
    """key, n_words, n_runs, the longest run, digests of all runs and of the text without its repeats; runs and collapsed if `whole`.

    Words are runs of anything but ASCII white space, numbered from 0. A run is a stretch with smallest
    period q, at least `least` words and `times` * q long, that no neighbour extends. The longest run wins by
    length, then the least start, then the least period; its columns are null where there is none. A word
    is dropped from `collapsed` if a run has it after its first q words; the words kept are joined by a space.

    Null, empty and blank texts have no words and no run; their digests are those of nothing. Each row is
    judged by itself: rows without a key, repeated rows and shared keys each have their result, other columns
    of any name are left aside, an empty table gives an empty one. There is no shuffle; a text is
    worked on as a whole, in memory in proportion to its words. Words are compared by 64-bit hashes.
    """
    if times < 2 or least < 2:
        raise ValueError("a run needs two periods and two words at least")
    kind = docs.select(F.col(key).alias("k")).schema["k"].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(lambda b: _rows(b, least, times, whole), f"k {kind}, {RUNS}")
    return rows.withColumnRenamed("k", key)


def with_looped_tails(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text: the text of every tenth document by hash ends in a loop, others are as they were.

    With h the crc32 of the key in decimal and g = h // 10: if h % 10 is 0 and the text has n > 0 words, every
    word i from a = g % n on becomes word a + (i - a) % p, p = 1 + (n - a) // (3 + g % 8). Rows without a key
    keep their text. Looped texts have one space between words.
    """
    h = F.crc32(F.col(key).cast("string"))
    w = F.regexp_extract_all(F.col(text), F.lit(SPACES), F.lit(0))
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.when(h % 10 == 0, w).alias("w"), F.floor(h / 10).alias("g"))
    n = F.size("w")
    rows = rows.withColumn("n", n).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    return rows.select(F.col("k").alias(key), F.when(F.col("n") > 0, looped(F.col("w"), F.col("n"), F.col("a"), F.col("p"))).otherwise(F.col("t")).alias(text))


def looped(w: Column, n: Column, a: Column, p: Column) -> Column:
    """The first a words, then the p words after them over and over, n words in all, joined by a space."""
    times = F.ceil((n - a) / p).cast("int")
    return F.array_join(F.slice(F.concat(F.slice(w, F.lit(1), a), F.flatten(F.array_repeat(F.slice(w, a + 1, p), times))), F.lit(1), n), " ")
