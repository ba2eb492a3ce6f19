"""Whitening, periodic runs and SimHash on small tables with odd rows, against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from millrace.llm import mixing, queries, runs, simhash, token_codec, whitening
from tests.llm.test_llm import KIND, ROWS

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VECTORS = "vec_id bigint, embedding array<float>, label int, v string, k int, deviation int, n string"


# whitening -----------------------------------------------------------------------------------


def vectors(n=300, d=6):
    x = np.random.default_rng(3).normal(0, 0.3, (n, d)).astype(np.float32)
    x[:, 1] += x[:, 0]
    good = [[float(v) for v in r] for r in x]
    return good + [good[0], good[1]], [None, [], [1.0] * (d - 1) + [None], [float("nan")] + [0.0] * (d - 1), [float("inf")] + [0.0] * (d - 1), [0.5] * (d - 2)]


def plain_whitening(rows):
    x = [[int(np.floor(1024 * float(np.float32(c)))) + 100000 for c in r] for r in rows]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    u = [[n * r[j] - s[j] for j in range(d)] for r in x]
    v = np.array([[sum(r[i] * r[j] for r in u) / n**3 for j in range(d)] for i in range(d)])
    e, w = np.linalg.eigh(v)
    e, w = e[::-1], w[:, ::-1]
    return [sum(c * c for c in r) for r in u], (np.array(u, float) / n) @ w / np.sqrt(e), e / np.trace(v)


def test_whitening_equals_a_plain_version(spark):
    good, bad = vectors()
    rows = [(i, r, 0, "x", 1, 2, "y") for i, r in enumerate(good)] + [(1000 + i, r, None, None, None, None, None) for i, r in enumerate(bad)]
    table = spark.createDataFrame(rows, VECTORS).repartition(5)
    got = whitening.whiten(table, most=4).collect()
    deviation, w, explained = plain_whitening(good)
    assert sorted((r.vec_id, r.component) for r in got) == [(i, c) for i in range(len(good)) for c in range(1, 5)]
    sign = {}
    for r in got:
        assert r.n == len(good)
        assert r.deviation == deviation[r.vec_id]
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9
        assert r.identity_error < 1e-9
        want = w[r.vec_id, r.component - 1]
        if abs(want) > 1e-3:
            assert sign.setdefault(r.component, np.sign(want * r.whitened)) == np.sign(want * r.whitened)
        assert abs(abs(r.whitened) - abs(want)) < 1e-7


def test_whitening_without_variance_and_without_rows(spark):
    same = spark.createDataFrame([(None, [0.5, 0.25, 1.0])] * 3 + [(7, [0.5, 0.25, 1.0])], "vec_id bigint, embedding array<double>")
    got = whitening.whiten(same).collect()
    assert len(got) == 12
    assert all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 and r.n == 4 for r in got)
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(5)], "vec_id bigint, embedding array<double>")
    got = whitening.whiten(line).collect()
    assert [r.whitened is None for r in sorted(got, key=lambda r: (r.vec_id, r.component))] == [False, True, True] * 5
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], "vec_id bigint, embedding array<float>")).count() == 0
    with pytest.raises(Exception, match="no exact whole number"):
        whitening.whiten(spark.createDataFrame([(1, [1e30])], "vec_id bigint, embedding array<double>")).collect()


@pytest.mark.parametrize("top", [2, 1000, 1 << 40, 1 << 50])
def test_bit_planes_give_exact_products(top):
    x = np.random.default_rng(top).integers(-top, top, (700, 5))
    x[:, 2] = 9
    sums, products = whitening.cross_products(x)
    wide = x.astype(object)
    assert sums == wide.sum(axis=0).tolist()
    assert all(products[i, j] == int((wide[:, i] * wide[:, j]).sum()) for i in range(5) for j in range(i, 5))
    assert whitening._squares(x) == [sum(int(v) ** 2 for v in r) for r in x]


# runs ----------------------------------------------------------------------------------------


def plain_runs(w, least=6, times=4):
    out, n = [], len(w)
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, times * q) and not any(q % r == 0 and all(w[x] == w[x + r] for x in range(i, i + length - r)) for r in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize(("least", "times"), [(6, 4), (2, 2), (6, 3), (9, 2)])
def test_runs_equal_a_plain_version(least, times):
    rng = random.Random(least * times)
    for _ in range(300):
        texts = []
        for _ in range(rng.randint(1, 5)):
            w = []
            while rng.random() < 0.85:
                root = [rng.randint(0, rng.choice([1, 2, 5])) for _ in range(rng.randint(1, 5))]
                w += (root * rng.randint(1, 7))[: rng.randint(1, 40)]
            texts.append(w)
        h = np.array([x * 7919 + 13 for w in texts for x in w], np.uint64)
        assert runs.runs_of(h, np.array([len(w) for w in texts]), least, times) == [plain_runs(w, least, times) for w in texts]


def looped_plainly(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is None or h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]


def expected_runs(doc_id, text):
    w = looped_plainly(doc_id, text)
    found = plain_runs(w)
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if found else None
    return (doc_id, len(found), *best, milli, digest("".join(f"{s},{n},{q}\n" for s, n, q in found)), digest(" ".join(x for i, x in enumerate(w) if i not in gone)))


ODD = [None, "", " \n", "a a a a a a", "a a a a a", "x y " * 9 + "x", "a b a b a b a b\x0ba b", "é é é é é é é", "one two three " * 3]


def test_runs_of_whole_rows(spark):
    rows = [r for r in ROWS if r[1] is None or len(r[1]) < 20000] + [(5000 + i, t, None, None, None, None, None, None) for i, t in enumerate(ODD * 6)]
    table = spark.createDataFrame(rows, KIND).repartition(3)
    found = runs.periodic_runs(runs.with_looped_tails(table))
    got = found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((expected_runs(r[0], r[1]) for r in rows), key=repr)
    assert any(r[1] for r in got.collect())
    for r in found.where("n_runs > 0").collect():
        assert len(r.runs) == r.n_runs
        assert hashlib.sha256(r.collapsed.encode()).hexdigest() == r.collapsed_sha256
    assert runs.periodic_runs(runs.with_looped_tails(spark.createDataFrame([], KIND))).count() == 0
    with pytest.raises(ValueError):
        runs.periodic_runs(table, times=1)


def test_query_of_runs_equals_a_plain_version(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    # the plain version takes the square of a text's length
    short = {i: t for i, t in rows if len(WORD.findall(t or "")) < 1500}
    got = {r[0]: tuple(r) for r in queries.op12_periodic_runs(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    assert {i: got[i] for i in short} == {i: expected_runs(i, t) for i, t in short.items()}


def test_runs_of_long_texts():
    for w, want in (([1] * 100_000, [(0, 100_000, 1)]), ([1, 2, 3] * 30_000, [(0, 90_000, 3)]), ([x for i in range(9000) for x in (1, 2, 3, 4, 5, 6, 7, 1000 + i)], [])):
        assert runs.runs_of(np.array(w, np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.array([len(w)])) == [want]


# simhash -------------------------------------------------------------------------------------


def plain_fingerprint(text, k=3):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, radius=2):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize(("parts", "tile"), [(None, simhash.TILE), (8, 3), (16, 1)])
def test_simhash_of_odd_rows(spark, parts, tile):
    base = "the quick brown fox jumps over the lazy dog and runs through the old forest to its den ".split() * 12
    near = [(8000 + i, " ".join([*base[:i], "Other", *base[i + 1 :]]), None, None, None, None, None, None) for i in range(0, 200, 7)]
    rows = ROWS + near + [(9000, None, None, None, None, None, None, None), (9001, "\t\n", None, None, None, None, None, None), (None, "a row of its own without a key", None, None, None, None, None, None)]
    got = simhash.near_copies(spark.createDataFrame(rows, KIND).repartition(3), parts=parts, tile=tile).collect()
    fps = [plain_fingerprint(r[1]) for r in rows]
    classes = plain_components(fps)
    least = {c: min((r[0] for r, k in zip(rows, classes, strict=True) if k == c and r[0] is not None), default=None) for c in classes}
    want = [(r[0], f"{f:016x}", least[c]) for r, f, c in zip(rows, fps, classes, strict=True)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert len({f for f, c in zip(fps, classes, strict=True) if least[c] == 8000}) > 3


def test_simhash_of_an_empty_table(spark):
    assert simhash.near_copies(spark.createDataFrame([], KIND)).count() == 0


def test_query_of_simhash_equals_a_plain_version(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    want = [(r.doc_id, f"{f:016x}", rows[c].doc_id) for r, f, c in zip(rows, fps, plain_components(fps), strict=True)]
    assert sorted(map(tuple, queries.op13_simhash(spark, sf_dir).collect())) == want


def test_cells_of_linked_fingerprints_meet(spark):
    """Whatever a link flips, the cell of one end is reached from that of the other."""
    rng = np.random.default_rng(5)
    for parts in (4, 8, 16):
        a = rng.integers(-(1 << 63), (1 << 63) - 1, 400)
        a[:2] = 0, -1
        flip = np.array([int(np.uint64(1) << np.uint64(x)) ^ (int(np.uint64(1) << np.uint64(y)) if x != y else 0) for x, y in rng.integers(0, 64, (400, 2))], object)
        b = [int(np.array([(int(x) & (2**64 - 1)) ^ f], np.uint64).view(np.int64)[0]) for x, f in zip(a, flip, strict=True)]
        both = spark.createDataFrame(list(zip(a.tolist(), b, strict=True)), "a bigint, b bigint")
        far = both.select((simhash.cell_of(both.a, parts, 2) - simhash.cell_of(both.b, parts, 2)).alias("d")).collect()
        assert {abs(r.d) for r in far} <= set(simhash.steps_within(parts, 2))
    assert [len(simhash.steps_within(p, 2)) for p in (4, 8, 16)] == [21, 73, 273]


def test_forest_of_dense_tiles():
    a = np.arange(300, dtype=np.uint64)
    assert simhash.forest(600, ((i, j + 300) for i, j in simhash.close_pairs(a, a, 9))).max() == 0


# hot groups of earlier operators ---------------------------------------------------------------


def test_equal_rows_are_numbered_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PIECE", 64)
    rows = [(None, "a", "one text")] * 1000 + [(1, None, "one text")] * 3 + [(1, "a", "one text"), (2, "b", None)]
    got = mixing.numbered(spark.createDataFrame(rows, "doc_id bigint, source string, mark string").repartition(4)).collect()
    want = {}
    for r in rows:
        want[r] = want.get(r, 0) + 1
    assert sorted((r.doc_id is None, str(r.doc_id), str(r.source), r.number) for r in got) == sorted((k[0] is None, str(k[0]), str(k[1]), i) for k, n in want.items() for i in range(1, n + 1))
    assert mixing.numbered(spark.createDataFrame([], "doc_id bigint, source string")).count() == 0
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        from pyspark.sql import functions as F

        spread = mixing.numbered(spark.createDataFrame(rows, "doc_id bigint, source string, mark string")).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert max(r["count"] for r in spread) < 700


def test_mixing_many_equal_rows(spark):
    text = " ".join(["word"] * 10)
    table = spark.createDataFrame([(None, text, "a")] * 400 + [(i, text + " x" * (i % 5), "b") for i in range(300)], "doc_id bigint, text string, source string").repartition(4)
    a, b = (sorted(map(tuple, mixing.mix_sources(t).select("doc_id", "source", "size", "target", "taken").collect()), key=repr) for t in (table, table.repartition(7)))
    assert a == b
    assert len(a) == 700
    for source in "ab":
        taken, target = sum(r[4] for r in a if r[1] == source), next(r[3] for r in a if r[1] == source)
        assert abs(taken - target) <= 7


def test_token_code_is_the_same_and_counted_in_place():
    """Blocks have the bytes they had, and a recount makes no arrays of the vocabulary's size."""
    rng = np.random.default_rng(6)
    ids = (3000 * rng.random(60_000) ** 4).astype(np.uint32)
    ids[30_000:45_000] = ids[:15_000]
    for n, crc in ((1, 3262942160), (63, 2241630747), (5_000, 3140849378), (60_000, 14816374)):
        block = token_codec.encode(ids[:n], 3000)
        assert zlib.crc32(block) == crc and (token_codec.decode(block) == ids[:n]).all()
    model = token_codec._Model(3000)
    own, cum = model.own, model.cum
    model.counts[7] = 5
    model.recount()
    assert model.own is own and model.cum is cum and own[7] > own[8]
