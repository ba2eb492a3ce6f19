"""SimHash near-copies: exact comparison of tiles of fingerprints, but for pairs of tiles whose bit counts are too far apart.

Two numbers that differ in r bits have bit counts that differ by at most r, and so has every part of their
bits: the counts of the parts differ by at most r in sum. Distinct fingerprints are therefore put in cells
by the bit counts of their parts, large cells are cut into tiles, and only tiles of cells within the radius meet.
In a pair of tiles every fingerprint of one is compared with every one of the other by exclusive or and a
count of bits, so no link is missed. A pair of tiles returns a forest of its links, one row for a
fingerprint at most, however dense they are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.wordbatch import Words, signed, slices
from millrace.operators.graph import connected_components
from millrace.session import materialize

WORDS, SEED, RADIUS = 3, 42, 2
#: fingerprints of a tile
TILE = 1 << 13
#: comparisons that are held at a time, and shingles whose bits are spread at a time
HELD, SPREAD = 1 << 18, 1 << 16


def bit_majorities(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each group of hashes, in order, the number whose bits are set in over half of them; 0 for an empty group."""
    ones = np.zeros((len(counts), 64), np.int64)
    doc = np.repeat(np.arange(len(counts)), counts)
    for at in range(0, len(h), SPREAD):
        part, own = h[at : at + SPREAD], doc[at : at + SPREAD]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        ones[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little").view(np.uint64).reshape(-1)


def _fingerprint_rows(batches: Iterable[pa.RecordBatch], k: int, seed: int) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh64_intdigest
    for part in slices(batches, "t"):
        words = Words(part.column("t"), lower=True)
        counts = words.counts
        length = words.end - words.start
        start = np.cumsum(length + 1) - length - 1
        raw, at = words.data.tobytes(), words.at.tolist()
        spaced = b" ".join(w for i, j in zip(at[:-1], at[1:], strict=True) for w in raw[i:j].split())
        n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
        first = np.repeat(words.of[:-1] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        last = first + np.repeat(np.minimum(counts, k), n) - 1
        a, b = start[first].tolist(), (start[last] + length[last]).tolist()
        h = np.fromiter((digest(spaced[i:j], seed) for i, j in zip(a, b, strict=True)), np.uint64, len(a))
        yield pa.record_batch([part.column("k"), pa.array(signed(bit_majorities(h, n)))], ["k", "fp"])


def simhashes(docs: DataFrame, words: int = WORDS, seed: int = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """k (the key) and fp, a number of 64 bits: bit by bit the majority of the hashes of all shingles, repeats included.

    A-Z count as a-z. A text of fewer words is one shingle, one without words has fp 0.
    """
    kind = docs.select(F.col(key).alias("k")).schema["k"].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(lambda b: _fingerprint_rows(b, words, seed), f"k {kind}, fp bigint")


# tiles ---------------------------------------------------------------------------------------


def parts_for(n: int) -> int:
    """Into how many parts of bits n fingerprints are counted: more when there are more, so that cells stay small.

    It decides which pairs of tiles are skipped, never which fingerprints are linked.
    """
    return 4 if n < 1 << 23 else 8 if n < 1 << 31 else 16


def cell_of(fp, parts: int, radius: int):
    """The bit counts of the parts of fp as digits of one number, with room for the radius on both sides."""
    width = 64 // parts
    base = width + 2 * radius + 1
    cell = F.lit(0).cast("bigint")
    for k in range(parts):
        count = F.bit_count(F.shiftrightunsigned(fp, width * k).bitwiseAND(F.lit((1 << width) - 1).cast("bigint")))
        cell = cell + (count + radius) * F.lit(base**k).cast("bigint")
    return cell


def steps_within(parts: int, radius: int) -> list[int]:
    """What leads from a cell to each cell within the radius, itself included; of two opposite steps, one."""
    base = 64 // parts + 2 * radius + 1
    found: set[tuple[int, ...]] = {(0,) * parts}
    edge = set(found)
    for _ in range(radius):
        edge = {(*s[:k], s[k] + d, *s[k + 1 :]) for s, k, d in product(edge, range(parts), (-1, 1))}
        found |= edge
    return sorted({abs(sum(d * base**k for k, d in enumerate(s))) for s in found})


def forest(n: int, links: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n nodes the least node that links lead to; links come in parts of bounded size."""
    root = np.arange(n)
    for u, v in links:
        while True:
            a, b = root[u], root[v]
            apart = a != b
            if not apart.any():
                break
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
    return root


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in a and in b that differ in at most radius bits, from bounded pieces of the comparison."""
    step = max(1, HELD // max(len(b), 1))
    for at in range(0, len(a), step):
        i, j = np.nonzero(np.bitwise_count(a[at : at + step, None] ^ b[None, :]) <= radius)
        if len(i):
            yield i + at, j


def _link_rows(batches: Iterable[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        src, dst = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for row in range(batch.num_rows):
            a, b = (batch.column(c)[row].values.to_numpy(zero_copy_only=False).view(np.uint64) for c in ("a", "b"))
            links = close_pairs(a, b, radius)
            first = next(links, None)
            if first is None:
                continue
            nodes = np.concatenate([a, b])
            root = forest(len(nodes), ((i, j + len(a)) for i, j in chain([first], links)))
            moved = np.flatnonzero((root != np.arange(len(nodes))) & (nodes[root] != nodes))
            src.append(nodes[moved])
            dst.append(nodes[root[moved]])
        yield pa.record_batch([pa.array(signed(np.concatenate(src))), pa.array(signed(np.concatenate(dst)))], ["src", "dst"])


def close_links(fps: DataFrame, radius: int = RADIUS, parts: int | None = None, tile: int = TILE) -> DataFrame:
    """src, dst: links whose components are those of all pairs of fps (distinct fp) that differ in at most radius bits."""
    parts = parts or parts_for(fps.count())
    placed = fps.select("fp", cell_of(F.col("fp"), parts, radius).alias("cell"))
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    sizes = materialize(sizes, "cells")
    # 17**4 cells at most with four parts
    of_cells = F.broadcast(sizes) if parts <= 4 else sizes
    dealt = placed.join(of_cells, "cell").withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")))
    tiles = materialize(dealt.groupBy("cell", "tile").agg(F.collect_list("fp").alias("fps")), "tiles")
    steps = F.array(*[F.lit(s).cast("bigint") for s in steps_within(parts, radius)])
    asked = tiles.select(F.col("cell").alias("own"), F.col("tile").alias("own_tile"), F.explode(steps).alias("step"), F.col("fps").alias("a")).withColumn("cell", F.col("own") + F.col("step"))
    asked = asked.join(of_cells, "cell").withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    asked = asked.withColumn("tile", F.col("tile").cast("bigint")).where("step > 0 OR own_tile <= tile")
    met = asked.select("cell", "tile", "a").join(tiles.select("cell", "tile", F.col("fps").alias("b")), ["cell", "tile"])
    return met.select("a", "b").mapInArrow(lambda rows: _link_rows(rows, radius), "src bigint, dst bigint")


def near_copies(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, seed: int = SEED, key: str = "doc_id", text: str = "text", parts: int | None = None, tile: int = TILE) -> DataFrame:
    """key, fingerprint (16 hex digits) and component_id: the least key reachable over fingerprints within the radius.

    Null, empty and blank texts have fingerprint zero and are linked by it like any others. Equal fingerprints
    are one node, so groups of copies cost a row each and no pairs. Rows without a key are linked like
    others, and count as least only where no row of the component has a key (component_id is null then); rows that
    share a key are told apart. Other columns of any name are left aside; an empty table gives an empty one.
    """
    own = materialize(simhashes(docs, words, seed, key, text), "simhashes")
    fps = materialize(own.groupBy("fp").agg(F.min("k").alias("least")), "fingerprints")
    classes = connected_components(close_links(fps, radius, parts, tile)).select(F.col("node").alias("fp"), "component")
    placed = materialize(fps.join(classes, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component")), "classes")
    best = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    found = placed.join(best, "component").select("fp", "component_id")
    return own.join(found, "fp").select(F.col("k").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
