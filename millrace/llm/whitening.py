"""Whitening of embeddings: exact cross-products from bit planes, then eigenvectors of the covariance.

An entry c becomes the whole number x = floor(scale * c) + shift. In a block of rows every dimension is
shifted by its own least x, so that what is left is small and not negative, and its bits are packed
across the rows: plane k of a dimension holds bit k of 64 rows in each word. The sum over the rows of a
product is then the sum over pairs of planes of 2**(k + l) times the number of bits that both have set.
Blocks add up as whole numbers, and the covariance is centred as such before it becomes floating point.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import materialize

SCALE, SHIFT = 1024, 100_000
#: rows whose planes are packed together: 256 words of 64 rows
BLOCK_ROWS = 1 << 14
#: whole numbers up to which doubles, and so scale * c, are exact
EXACT = 1 << 53
#: batches that tasks exchange are cut to so many rows before they are turned into numbers
ROWS = 1 << 12


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows whose vector is there, has entries, and has none that is null, NaN or infinite."""
    c = F.col(vector)
    bad = F.exists(c, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    return vectors.where(c.isNotNull() & (F.size(c) > 0) & ~bad)


def whole_numbers(column: pa.Array, scale: int = SCALE, shift: int = SHIFT) -> np.ndarray:
    """x of each entry of a batch of vectors of one length; entries that a double can't scale exactly are an error."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.floor(flat * scale)
    if len(x) and np.abs(x).max() >= EXACT:
        raise ValueError(f"an entry times {scale} is beyond 2**53 and has no exact whole number")
    return (x.astype(np.int64) + shift).reshape(len(column), -1)


def bit_planes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Planes of the columns of y (rows x dimensions, not negative): words, the column and the bit of each plane.

    Planes without a bit set are left out; rows are padded with zeros to whole words.
    """
    n, d = y.shape
    words, column, bit = [], [], []
    for j in range(d):
        v = np.ascontiguousarray(y[:, j])
        for k in range(int(v.max()).bit_length() if n else 0):
            packed = np.packbits(((v >> k) & 1).astype(np.uint8))
            packed = np.concatenate([packed, np.zeros(-len(packed) % 8, np.uint8)])
            words.append(packed.view(np.uint64))
            column.append(j)
            bit.append(k)
    shape = (len(words), -(-n // 64))
    return np.array(words, np.uint64).reshape(shape), np.array(column, np.int64), np.array(bit, np.int64)


def cross_products(x: np.ndarray) -> tuple[list[int], dict[tuple[int, int], int]]:
    """Sums of the columns of x, and of the products of columns i <= j, as exact whole numbers."""
    n, d = x.shape
    low = x.min(axis=0)
    planes, column, bit = bit_planes(x - low)
    sums = [0] * d
    products = np.zeros((d, d), object)
    first = np.searchsorted(column, np.arange(d + 1))
    if len(planes):
        for k, total in enumerate(np.bitwise_count(planes).sum(axis=1, dtype=np.int64)):
            sums[column[k]] += int(total) << int(bit[k])
        for i in range(d):
            most = 0
            counts = []
            for k in range(first[i], first[i + 1]):
                counts.append(np.bitwise_count(planes[k] & planes[first[i] :]).sum(axis=1, dtype=np.int64))
                most = max(most, int(bit[k]))
            if not counts:
                continue
            exact = most + int(bit[first[i] :].max()) + n.bit_length() + 2 * d.bit_length() + 12 < 63
            kind = np.int64 if exact else object
            weight = np.array([1 << int(b) for b in bit[first[i] :]], kind)
            row = sum(c.astype(kind) * weight * (1 << int(bit[k])) for c, k in zip(counts, range(first[i], first[i + 1]), strict=True))
            for j in range(i, d):
                products[i, j] = int(row[first[j] - first[i] : first[j + 1] - first[i]].sum())
    out = {}
    base = [int(v) for v in low]
    for i in range(d):
        for j in range(i, d):
            out[i, j] = int(products[i, j]) + base[i] * sums[j] + base[j] * sums[i] + n * base[i] * base[j]
    return [s + n * b for s, b in zip(sums, base, strict=True)], out


SCATTER = "i int, j int, total decimal(38,0)"


def _scatter_rows(batches: Iterable[pa.RecordBatch], scale: int, shift: int) -> Iterator[pa.RecordBatch]:
    """The sums of a task, a row for each pair of dimensions; i = -1: sums of a dimension, i = j = -1: rows."""
    n, sums, products = 0, None, None
    kept: list[np.ndarray] = []
    waiting = 0

    def add() -> None:
        nonlocal n, sums, products, waiting
        x = np.concatenate(kept)
        kept.clear()
        waiting = 0
        s, p = cross_products(x)
        n += len(x)
        sums = s if sums is None else [a + b for a, b in zip(sums, s, strict=True)]
        products = p if products is None else {k: v + p[k] for k, v in products.items()}

    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            kept.append(whole_numbers(batch.slice(at, ROWS).column("v"), scale, shift))
            waiting += len(kept[-1])
            if waiting >= BLOCK_ROWS:
                add()
    if kept:
        add()
    if n:
        rows = [(-1, -1, n)] + [(-1, j, s) for j, s in enumerate(sums)] + [(i, j, v) for (i, j), v in products.items()]
        i, j, v = zip(*rows, strict=True)
        yield pa.record_batch([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(v, pa.decimal128(38, 0))], ["i", "j", "total"])


@dataclass(frozen=True)
class Whitening:
    """n rows, the sums of their x, the trace of the covariance, eigenvalues falling, and their unit vectors as columns."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    axes: np.ndarray
    scale: int
    shift: int


def fit_whitening(vectors: DataFrame, vector: str = "embedding", most: int = 8, scale: int = SCALE, shift: int = SHIFT) -> Whitening | None:
    """Fit to all usable vectors of the commonest length (the longest of equally common ones); None without any.

    What reaches the driver is one sum for each pair of dimensions, however many rows there are.
    """
    good = usable(vectors, vector).select(F.col(vector).alias("v"))
    lengths = good.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not lengths:
        return None
    d = lengths[0]["d"]
    parts = good.where(F.size("v") == d).mapInArrow(lambda b: _scatter_rows(b, scale, shift), SCATTER)
    total = {(r["i"], r["j"]): int(r["total"]) for r in parts.groupBy("i", "j").agg(F.sum("total").alias("total")).collect()}
    n, sums = total[-1, -1], [total[-1, j] for j in range(d)]
    covariance = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            covariance[i, j] = covariance[j, i] = (n * total[i, j] - sums[i] * sums[j]) / (n * n)
    values, axes = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[: min(most, d)]
    axes = axes[:, order]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    trace = sum(n * total[i, i] - sums[i] ** 2 for i in range(d)) / (n * n)
    # what rounding leaves of a direction without variance
    least = d * np.finfo(float).eps * max(float(values.max()), 0.0)
    return Whitening(n, sums, trace, np.where(values[order] > least, values[order], 0.0), axes, scale, shift)


def _squares(u: np.ndarray) -> list[int]:
    """The exact sum of squares of each row."""
    top = int(np.abs(u).max()) if u.size else 0
    if top * top * u.shape[1] < 1 << 63:
        return (u * u).sum(axis=1).tolist()
    if top * u.shape[1] < 1 << 52:
        high, low = u >> 26, u & ((1 << 26) - 1)
        parts = ((high * high).sum(axis=1), (high * low).sum(axis=1), (low * low).sum(axis=1))
        return [(a << 52) + (b << 27) + c for a, b, c in zip(*(p.tolist() for p in parts), strict=True)]
    return [sum(v * v for v in row) for row in u.tolist()]


def _whitened_rows(batches: Iterable[pa.RecordBatch], fit: Whitening) -> Iterator[pa.RecordBatch]:
    some = fit.values > 0
    into = np.where(some, fit.axes / np.sqrt(np.where(some, fit.values, 1.0)), np.nan)
    sums = np.array(fit.sums, object)
    small = max(map(abs, fit.sums)) < 1 << 62
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            x = whole_numbers(batch.column("v"), fit.scale, fit.shift)
            if small and fit.n * int(np.abs(x).max()) < 1 << 62:
                u = x * fit.n - sums.astype(np.int64)
                centred = u / fit.n
                squares = _squares(u)
            else:
                u = x.astype(object) * fit.n - sums
                centred = (u / fit.n).astype(np.float64)
                squares = [sum(v * v for v in row) for row in u.tolist()]
            w = centred @ into
            flat = pa.array(w.ravel(), pa.float64(), mask=np.isnan(w.ravel()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), flat)
            big = [s if s < 10**38 else None for s in squares]
            yield pa.record_batch([*(batch.column(k) for k in range(batch.num_columns - 1)), pa.array(big, pa.decimal128(38, 0)), lists], [*batch.schema.names[:-1], "deviation", "whitened"])


def whiten(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", most: int = 8, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """key, component (from 1, by falling eigenvalue), n, deviation decimal(38,0), whitened, explained, identity_error.

    Rows whose vector is null, empty or holds null, NaN or infinite entries have no result, nor have
    rows whose vector isn't of the commonest length. Keys aren't looked at: rows without one, repeated rows
    and rows that share one each have their results, and other columns of any name are left aside. An
    empty table, or one without usable vectors, gives no rows. A finite entry that has no exact whole number
    (its product with scale is 2**53 or more) is an error, not a wrong result. deviation is null beyond 38 digits. Along a
    component without variance (equal vectors, a single row, fewer directions than components) whitened
    is null; explained is null where there is no variance at all, and identity_error where no component
    has any. identity_error is measured on the whitened rows: their covariance, centred, against the
    identity.

    Three passes over the vectors: their lengths, the bit planes, the projection. The last is written
    once and read for its covariance and for the result.
    """
    spark = vectors.sparkSession
    kind = vectors.select(F.col(key).alias("k")).schema["k"].dataType.simpleString()
    out = f"{key} {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    fit = fit_whitening(vectors, vector, most, scale, shift)
    if fit is None:
        return spark.createDataFrame([], out)
    d = len(fit.sums)
    good = usable(vectors, vector).select(F.col(key).alias("k"), F.col(vector).alias("v")).where(F.size("v") == d)
    rows = materialize(good.mapInArrow(lambda b: _whitened_rows(b, fit), f"k {kind}, deviation decimal(38,0), whitened array<double>"), "whitened")
    some = [c for c in range(len(fit.values)) if fit.values[c] > 0]
    error = None
    if some:
        pairs = [(a, b) for a in some for b in some if a <= b]
        found = rows.agg(*[F.covar_pop(F.col("whitened")[a], F.col("whitened")[b]).alias(f"c{a}_{b}") for a, b in pairs]).first()
        error = max(abs(found[f"c{a}_{b}"] - (a == b)) for a, b in pairs)
    explained = F.array(*[F.lit(float(v) / fit.trace if fit.trace > 0 else None).cast("double") for v in fit.values])
    placed = rows.select("k", "deviation", F.posexplode("whitened").alias("p", "w"))
    return placed.select(F.col("k").alias(key), (F.col("p") + 1).alias("component"), F.lit(fit.n).cast("bigint").alias("n"), "deviation", F.col("w").alias("whitened"), explained[F.col("p")].alias("explained"), F.lit(error).cast("double").alias("identity_error"))
