"""Packing documents into sequences of a fixed number of tokens by non-negative least squares.

Each document gives full windows and a rest. The histogram of rests (one count per length, so
bounded by the window) goes to the driver, which enumerates pairs and triples of lengths that fill a
window, solves for how often each is repeated by non-negative least squares and rounds down to what
the histogram holds. Rests find their place by their rank among those of their length. What is left
is packed greedily in groups of bounded size, with cuts, and a group's last tokens become sequences
of powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.tokens import TextEncoder
from millrace.llm.wordbatch import slices
from millrace.session import materialize

WINDOW = 1024
#: rests of one greedy group
GROUP = 2048
#: sequence ids kept for each greedy group
STRIDE = 1 << 24


def combinations(window: int) -> np.ndarray:
    """All pairs and triples of lengths that add up to window; unused places are 0."""
    a = np.arange(1, window // 2 + 1)
    pairs = np.stack([a, window - a, np.zeros_like(a)], 1)
    x, y = np.meshgrid(np.arange(1, window), np.arange(1, window), indexing="ij")
    z = window - x - y
    ok = (x <= y) & (y <= z)
    return np.concatenate([pairs, np.stack([x[ok], y[ok], z[ok]], 1)])


def repeat_counts(histogram: np.ndarray, window: int, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """The combinations that are used and how often, never more of a length than there are.

    Non-negative least squares by accelerated projected gradient steps; combinations that use a
    length twice count it twice. The solution is rounded to the nearest count that is left, the
    largest first, and what is left then is matched once more, from long to short.
    """
    combos = combinations(window)
    h = histogram.astype(float)
    weight = combos > 0
    # only combinations of lengths that occur can be used at all
    usable = ((h[combos] > 0) | ~weight).all(1)
    combos, weight = combos[usable], weight[usable]
    if not len(combos):
        return combos, np.zeros(0, np.int64)

    def uses(x):
        return sum(np.bincount(combos[:, j], weights=x * weight[:, j], minlength=window + 1) for j in range(3))

    # a bound of the largest eigenvalue: most uses of one length times lengths of a combination
    step = 1.0 / (3.0 * uses(np.ones(len(combos))).max())
    scale = 1.0 / np.maximum(uses(np.ones(len(combos))), 1.0)
    x = np.min(np.where(weight, (h * scale)[combos], np.inf), 1)
    y, t = x.copy(), 1.0
    for _ in range(rounds):
        rest = uses(y) - h
        rest[0] = 0
        new = np.maximum(y - step * (rest[combos] * weight).sum(1), 0)
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / u * (new - x), new, u
    counts = np.zeros(len(combos), np.int64)
    left = histogram.astype(np.int64).copy()

    def take(i: int, most: int) -> None:
        own = [int(v) for v in combos[i] if v]
        n = min([most, *(int(left[v]) // own.count(v) for v in own)])
        if n > 0:
            counts[i] += n
            for v in own:
                left[v] -= n

    for i in np.argsort(-x, kind="stable"):
        if x[i] < 0.5:
            break
        take(int(i), int(x[i] + 0.5))
    for i in np.argsort(-combos.max(1), kind="stable"):
        if all(left[v] for v in combos[i] if v):
            take(int(i), 1 << 62)
    used = counts > 0
    return combos[used], counts[used]


def slots(combos: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """Rows of length, first rank, ranks, first sequence, offset: where rests of a length go, by rank."""
    taken, rows, sequence = np.zeros(window + 1, np.int64), [], 0
    for own, n in zip(combos.tolist(), counts.tolist(), strict=True):
        offset = 0
        for v in own:
            if v:
                rows.append((v, taken[v], n, sequence, offset))
                taken[v] += n
                offset += v
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def greedy(lengths: list[int], window: int) -> list[tuple[int, int, int, int, int]]:
    """(rest, start in it, length, sequence, offset): the longest rest that fits, else a cut one."""
    heap = sorted((n, i) for i, n in enumerate(lengths) if n)
    out, sequence, offset, total = [], 0, 0, sum(lengths)
    tail = total % window
    sizes = [window] * (total // window) + [1 << b for b in range(tail.bit_length() - 1, -1, -1) if tail >> b & 1]
    start = [0] * len(lengths)
    for sequence, size in enumerate(sizes):
        offset = 0
        while offset < size:
            gap = size - offset
            k = bisect_right(heap, (gap, len(lengths))) - 1
            if k >= 0:
                n, i = heap.pop(k)
                piece = n
            else:
                n, i = heap.pop(0)
                piece = gap
            out.append((i, start[i], piece, sequence, offset))
            start[i] += piece
            offset += piece
            if piece < n:
                entry = (n - piece, i)
                heap.insert(bisect_right(heap, entry), entry)
    return out


def _tokens(docs: DataFrame, vocabulary: str, end_id: int, window: int) -> DataFrame:
    """One row a document: its place, ids of its rest, and checksums of its whole windows."""
    kind = "part int, row bigint, doc_id bigint, doc_tokens bigint, windows_before bigint, rest int, nth bigint, crcs array<bigint>, rest_crc bigint, rest_ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, row, windows = TextEncoder.of(vocabulary), TaskContext.get().partitionId(), 0, 0
        seen = np.zeros(window, np.int64)
        for piece in slices(batches):
            ids, at = encoder.encode(piece.column("text"))
            ids = np.insert(ids, at[1:], end_id)
            at = at + np.arange(len(at))
            n = np.diff(at)
            full, rest = n // window, n % window
            order = np.argsort(rest, kind="stable")
            nth = np.empty(len(n), np.int64)
            nth[order] = np.arange(len(n)) - np.searchsorted(rest[order], rest[order])
            nth += seen[rest]
            seen += np.bincount(rest, minlength=window)
            raw = memoryview(ids.astype("<u4").tobytes())
            crcs = [[zlib.crc32(raw[4 * (a + window * k) : 4 * (a + window * (k + 1))]) for k in range(f)] for a, f in zip(at[:-1].tolist(), full.tolist(), strict=True)]
            tails = [bytes(raw[4 * (b - r) : 4 * b]) for b, r in zip(at[1:].tolist(), rest.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(n), part, np.int32)), pa.array(row + np.arange(len(n))), piece.column("doc_id"), pa.array(n), pa.array(windows + np.cumsum(full) - full),
                    pa.array(rest.astype(np.int32)), pa.array(nth), pa.array(crcs, pa.list_(pa.int64())), pa.array([zlib.crc32(x) for x in tails], pa.int64()), pa.array(tails, pa.binary()),
                ],
                [x.split(" ")[0] for x in kind.split(", ")],
            )
            row += len(n)
            windows += int(full.sum())

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, kind)


_PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def _greedy_pieces(rows: DataFrame, first: int, window: int) -> DataFrame:
    """Pack each group of rests by itself; the rows of a group follow one another."""

    def pack(group: int, rows: list[tuple]) -> list[tuple]:
        rows.sort(key=lambda r: (r[0], r[1]))
        out = []
        for i, start, length, sequence, offset in greedy([len(r[4]) // 4 for r in rows], window):
            _, _, doc_id, tokens, raw = rows[i]
            out.append((doc_id, tokens - len(raw) // 4 + start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), tokens, first + group * STRIDE + sequence, offset))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def out(found):
            return pa.RecordBatch.from_arrays([pa.array([x[j] for x in found], pa.int64()) for j in range(7)], [x.split(" ")[0] for x in _PIECE.split(", ")])

        for batch in batches:
            found = []
            for group, *row in zip(*(batch.column(c).to_pylist() for c in ("group", "part", "row", "doc_id", "doc_tokens", "rest_ids")), strict=True):
                if group != key:
                    found += pack(key, held) if held else []
                    key, held = group, []
                held.append(tuple(row))
            yield out(found)
        yield out(pack(key, held) if held else [])

    return rows.select("group", "part", "row", "doc_id", "doc_tokens", "rest_ids").mapInArrow(run, _PIECE)


def pack(docs: DataFrame, vocabulary: str, end_id: int = 0, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece.

    A document is the ids of its text (null: empty) and end_id; each id is in exactly one piece.
    Only the documents whose rest fits no combination are cut other than at multiples of window.
    Rows with the same doc_id are packed each by itself. An empty table has no pieces.
    """
    spark = docs.sparkSession
    tokens = materialize(_tokens(docs, vocabulary, end_id, window), "tokens")
    # whole windows: numbered by part, then within it
    parts = tokens.groupBy("part").agg(F.sum(F.size("crcs")).alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("parts_before"), "n")
    counted = tokens.groupBy("part", "rest").agg(F.count(F.lit(1)).alias("n"))
    histogram = np.zeros(window + 1, np.int64)
    for r in counted.groupBy("rest").agg(F.sum("n").alias("n")).collect():
        histogram[r["rest"]] = r["n"] if r["rest"] else 0
    n_windows = tokens.agg(F.sum(F.size("crcs")).alias("n")).first()["n"] or 0
    combos, counts = repeat_counts(histogram, window)
    table = slots(combos, counts, window)
    n_filled = int(counts.sum())
    taken = np.bincount(table[:, 0], weights=table[:, 2], minlength=window + 1).astype(np.int64)
    n_left = int((histogram - taken).sum())

    names = tokens.select("part", "row", "doc_id", "doc_tokens", "windows_before", "rest", "nth", "crcs", "rest_crc")
    whole = names.where(F.size("crcs") > 0).join(parts.select("part", "parts_before"), "part")
    whole = whole.select("doc_id", "doc_tokens", (F.col("parts_before") + F.col("windows_before")).alias("at"), F.posexplode("crcs").alias("k", "ids_crc32"))
    whole = whole.select("doc_id", (F.col("k").cast("bigint") * window).alias("start"), F.lit(window).cast("bigint").alias("length"), "ids_crc32", "doc_tokens", (F.col("at") + F.col("k")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))

    # rank of a rest among those of its length: those of earlier parts, then its place in its own
    before = counted.where("rest > 0").select("part", "rest", (F.sum("n").over(Window.partitionBy("rest").orderBy("part")) - F.col("n")).alias("ranks_before"))
    ranked = names.where("rest > 0").join(before, ["part", "rest"]).select("part", "row", "doc_id", "doc_tokens", "rest", "rest_crc", (F.col("ranks_before") + F.col("nth")).alias("rank"))
    sent = spark.sparkContext.broadcast((table, taken))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, taken = sent.value
        wide = 1 << 44
        keys = table[:, 0] * wide + table[:, 1]
        for batch in batches:
            rest, rank = batch.column("rest").to_numpy().astype(np.int64), batch.column("rank").to_numpy()
            k = np.maximum(np.searchsorted(keys, rest * wide + rank, "right") - 1, 0)
            placed = rank < taken[rest]
            row = table[k] if len(table) else np.zeros((len(rest), 5), np.int64)
            columns = [batch.column(c) for c in ("part", "row", "doc_id", "doc_tokens", "rest", "rest_crc")]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(np.where(placed, row[:, 3] + rank - row[:, 1], -1)), pa.array(np.where(placed, row[:, 4], -1))], ["part", "row", "doc_id", "doc_tokens", "rest", "rest_crc", "sequence", "offset"])

    spots = ranked.mapInArrow(place, "part int, row bigint, doc_id bigint, doc_tokens bigint, rest int, rest_crc bigint, sequence bigint, offset bigint")
    spots = materialize(spots, "spots")
    fits = spots.where("sequence >= 0").select("doc_id", (F.col("doc_tokens") - F.col("rest")).alias("start"), F.col("rest").cast("bigint").alias("length"), F.col("rest_crc").alias("ids_crc32"), "doc_tokens", (F.col("sequence") + n_windows).alias("sequence_id"), "offset")
    groups = max(1, -(-n_left // GROUP))
    rests = spots.where("sequence < 0").select("part", "row", F.pmod(F.xxhash64("part", "row"), F.lit(groups)).alias("group"))
    rests = tokens.select("part", "row", "doc_id", "doc_tokens", "rest_ids").join(rests, ["part", "row"])
    rests = rests.repartition("group").sortWithinPartitions("group")
    return whole.unionByName(fits).unionByName(_greedy_pieces(rests, n_windows + n_filled, window))
