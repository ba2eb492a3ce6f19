"""An index that follows edits against one that is built anew, and its layout."""

import uuid
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.catalogue import queries
from millrace.functions.text import search_tokens
from millrace.operators import chunking, enrich, lexical
from millrace.operators.scopes import Scope
from millrace.plans import batch
from millrace.plans import search as plans
from millrace.plans.index import Index
from millrace.session import shared_dir

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def text_of(i, version=0):
    return " ".join(WORDS[(i * 7 + j * (3 + version)) % len(WORDS)] for j in range(20 + i % 9)) + f" only{i} v{version}"


def chunks_of(spark, rows):
    """Chunks of (file_id, text) rows."""
    texts = spark.createDataFrame(rows, "file_id string, text string").withColumn("source_relpath", F.concat(F.lit("src/"), "file_id"))
    return chunking.chunks(texts, "window", 80, 20)


def vectors_of(chunks):
    return chunks.select("chunk_id", F.array(F.length("text").cast("float"), F.col("chunk_index").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))


def found(index, query, **how):
    got = plans.search(index, query, top_k=how.pop("top_k", 25), **how)
    return [(r["chunk_id"], round(r["score"], 9), r["text"], r["snippet"], r["source_origin"]) for r in got.collect()]


@pytest.fixture
def where(spark):
    return f"{shared_dir(spark)}/index-test-{uuid.uuid4().hex}"


def test_updates_equal_a_rebuild(spark, where):
    now = {f"f{i:02d}": text_of(i) for i in range(40)}
    own = chunks_of(spark, list(now.items()))
    index = plans.build(own, f"{where}/a", vectors_of(own), shards=4)
    steps = [({"f03": text_of(3, 1), "f07": text_of(7, 1), "new": text_of(99, 1)}, []), ({"f03": text_of(3, 2)}, ["f08"]), ({}, ["f11", "f12", "unknown"]), ({"f11": text_of(11, 5), "f20": ""}, [])]
    for changed, gone in steps:
        now = {k: v for k, v in (now | changed).items() if k not in gone}
        some = chunks_of(spark, list(changed.items())) if changed else own.limit(0)
        index.update(spark.createDataFrame([(k,) for k in [*changed, *gone, None]], "file_id string"), some, vectors_of(some))
        fresh_chunks = chunks_of(spark, list(now.items()))
        fresh = plans.build(fresh_chunks, f"{where}/{uuid.uuid4().hex}", vectors_of(fresh_chunks), shards=4)
        assert index.stats()[0] == fresh.stats()[0]
        assert abs(index.stats()[1] - fresh.stats()[1]) < 1e-9
        for query, how in (("alpha v1 only3 only11", {}), ("beta v2 v5 gamma gamma", {"include_zero": True, "top_k": 200}), ("kappa", {"mode": "hybrid", "query_vector": [0.1, 1.0, 0.5]}), ("iota", {"scope": Scope("folder", "src/f03")})):
            assert found(index, query, **how) == found(fresh, query, **how), query
    merged = index.merge()
    assert len(merged.parts()) == 1
    assert merged.dead().isEmpty()
    assert found(merged, "alpha v1 only3 only11") == found(fresh, "alpha v1 only3 only11")
    assert merged.chunks().count() == fresh.chunks().count()
    with pytest.raises(ValueError):
        index.update(spark.createDataFrame([("f01",)], "file_id string"), chunks_of(spark, [("f02", "other")]))


def test_an_index_without_chunks(spark, where):
    none = chunks_of(spark, [("a", " ")])
    index = plans.build(none, where)
    assert index.stats() == (0, None)
    assert found(index, "alpha") == []
    some = chunks_of(spark, [("a", "alpha beta"), ("b", "beta ... 1 2")])
    index.update(some.select("file_id"), some)
    assert [h[0] for h in found(index, "alpha beta")] == ["chunk-a-000001", "chunk-b-000001"]
    index.delete(some.select("file_id"))
    assert found(index, "beta", include_zero=True) == []


def test_zeros_fill_up_an_index_as_they_do_a_scan(spark, where):
    own = chunks_of(spark, [(f"f{i}", text_of(i)) for i in range(12)] + [("signs", "1 2 3 !")])
    index = plans.build(own, where)
    for query in ("only3", "nothing", "", "alpha only5"):
        assert found(index, query, include_zero=True, top_k=99) == found(own, query, include_zero=True, top_k=99)
    assert len(found(index, "only3", include_zero=True, top_k=99)) == own.count()
    assert found(index, "", include_zero=True) == []


def test_layout(spark, where, capsys):
    """The postings of a frequent term are several files, and the texts of a few hits are found in a few folders."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        index = plans.build(chunks_of(spark, [(f"f{i:03d}", "common " * 60 + f"only{i}") for i in range(200)]), where, shards=8)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    postings = index.postings()
    assert postings.where("term = 'common'").select(F.input_file_name()).distinct().count() > 1
    few = index.by_ids(["chunk-f001-000001"])
    assert few.count() == 1
    few.explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [shard" in plan or "PartitionFilters: [isnotnull(shard" in plan
    assert "(chunk_id,chunk-f001-000001)" in plan.replace(" ", "") or "In(chunk_id" in plan
    assert Index(spark, where, 8).by_ids([]).count() == 0


def test_chunks_of_a_file_lie_together(spark, where):
    """Overlapping chunks are neighbours in one folder, so what they repeat is packed away; hits are found with their files or without."""
    own = chunks_of(spark, [(f"f{i:02d}", "\n\n".join(text_of(i) + f" p{j}" for j in range(5))) for i in range(20)])
    index = plans.build(own, where, shards=8)
    folders = index.chunks().groupBy("file_id").agg(F.countDistinct("shard").alias("n"))
    assert folders.where("n > 1").count() == 0 and index.chunks().select("shard").distinct().count() > 1
    numbers = index.numbered().groupBy("file_id").agg((F.max("_num") - F.min("_num") + 1 - F.count(F.lit(1))).alias("gaps"))
    assert numbers.where("gaps <> 0").count() == 0
    hits = own.select("chunk_id", "file_id").limit(7).collect()
    ids, files = [r[0] for r in hits], [r[1] for r in hits]
    assert sorted(map(tuple, index.by_ids(ids).collect())) == sorted(map(tuple, index.by_ids(ids, files).collect())) == sorted(map(tuple, own.where(F.col("chunk_id").isin(*ids)).select(*index.by_ids(ids).columns).collect()))


def test_hits_are_cut_by_number(spark, where, monkeypatch):
    """What is known of chunks is met by the few that may be hits and isn't shuffled for them, nor written again with vectors; ties and scopes lose nothing."""
    own = chunks_of(spark, [(f"f{i:02d}", text_of(i // 4)) for i in range(32)])
    index = plans.build(own, where, vectors_of(own), shards=4)
    assert set(index._live("vectors").columns) == {"_num", "embedding", "_seq"}
    few = index.scored("alpha only3", 5)
    assert few.count() < index.scored("alpha only3").count()
    plan = few._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    some = chunks_of(spark, [("f03", text_of(0, 1))])
    for changed in (None, some):
        if changed is not None:
            index.update(changed.select("file_id"), changed, vectors_of(changed))
        pinned = index.pinned()
        live = pinned.scored("alpha only0 beta")
        near = pinned.vectors().withColumn("score", F.element_at("embedding", 1).cast("double")).drop("embedding")
        for scope, most in ((Scope(), 1), (Scope("object", "f03"), 100_000)):
            monkeypatch.setattr("millrace.operators.lexical.FEW", most)
            inside = F.lit(True) if scope.kind == "root" else F.col("file_id") == scope.id
            for all_, mode, vector in ((live, "lexical", None), (near, "semantic", [1.0, 0.0, 0.0])):
                best = all_.where(inside).orderBy(F.desc(F.round("score", 9)), "source_relpath", "chunk_id").limit(6).select("chunk_id", F.round("score", 9)).collect()
                got = plans.search(index, "alpha only0 beta", mode, 6, scope, query_vector=vector).select("chunk_id", F.round("score", 9)).collect()
                assert list(map(tuple, got)) == list(map(tuple, best)), (scope, mode)


def test_postings_hold_numbers_alone(spark, where):
    """What a build writes grows with the texts: postings don't repeat what is known of their chunks, and nothing is shuffled."""
    own = chunks_of(spark, [(f"{i:02d}" * 40, " ".join(f"{w}{(i * j) % 97}" for j in range(40) for w in WORDS)) for i in range(60)])
    index = plans.build(own, where)
    assert set(index.postings().columns) == {"term", "_seq", "_num", "tf", "dl"}
    size = lambda what: sum(p.stat().st_size for p in Path(where.removeprefix("file:").replace("//", "/")).rglob("*.parquet") if f"/{what}/" in str(p))
    assert 0 < size("postings") < 2 * own.agg(F.sum(F.length("text"))).first()[0]
    counted = own.select("chunk_id", F.explode(search_tokens(F.col("text"))).alias("term")).groupBy("term", "chunk_id").agg(F.count(F.lit(1)).cast("double").alias("tf"))
    named = index.postings().join(index.numbered(), ["_seq", "_num", "dl"]).select("term", "chunk_id", "tf")
    assert sorted(map(tuple, named.collect())) == sorted(map(tuple, counted.collect()))


def test_many_questions_by_block(spark, where):
    """More questions than a task takes, over several parts with dead chunks: those of a search for each by itself."""
    own = chunks_of(spark, [(f"f{i:02d}", text_of(i)) for i in range(30)])
    index = plans.build(own, where)
    some = chunks_of(spark, [("f03", text_of(3, 1)), ("new", text_of(99, 1))])
    index.update(some.select("file_id"), some)
    before, batch.TOGETHER = batch.TOGETHER, 2
    try:
        asked = {i: q for i, q in enumerate(("alpha only3", "v1 beta beta", "kappa iota", "nothing", ""))}
        got = batch.search_many(index, spark.createDataFrame(list(asked.items()), "question_id bigint, text string"), 7).orderBy("question_id", "rank").collect()
    finally:
        batch.TOGETHER = before
    for i, q in asked.items():
        assert [(r["chunk_id"], round(r["score"], 9)) for r in got if r["question_id"] == i] == [h[:2] for h in found(index, q, top_k=7)]


def test_an_update_notes_what_dies_alone(spark, where):
    """Files that no part holds need no note, so an index filled by updates is read without a join."""
    own = chunks_of(spark, [("a", text_of(1)), ("b", text_of(2))])
    index = plans.build(own.limit(0), where).update(own, own)
    assert index.dead().isEmpty() and not index.has_dead()
    index.update(own.select("file_id").where("file_id = 'a'"), chunks_of(spark, [("a", text_of(1, 1))]))
    assert [r["file_id"] for r in index.dead().collect()] == ["a"]


def test_a_whole_part_is_not_written_again(spark, where):
    """A merge of one part with all rows alive writes no texts; one of several parts, or with dead rows, writes them as one."""
    own = chunks_of(spark, [(f"f{i}", text_of(i)) for i in range(12)])
    index = plans.build(own.limit(0), where).update(own, own)
    before, parts = found(index, "alpha only3"), lambda: {p.name for p in Path(where.removeprefix("file:").replace("//", "/"), "parts").iterdir()}
    had = parts()
    assert [p[3] for p in index.merge().parts()] == [own.count()]
    assert parts() == had and found(index, "alpha only3") == before and index.stats()[0] == own.count()
    index.delete(own.select("file_id").where("file_id = 'f5'"))
    left = found(index, "alpha only3")
    merged = index.merge()
    assert len(parts()) == len(had) + 1 and len(merged.parts()) == 1 and merged.dead().isEmpty()
    assert found(merged, "alpha only3") == left == [h for h in found(merged, "alpha only3") if "f5" not in h[0]]


def test_texts_of_an_index_are_packed(spark, where):
    index = plans.build(chunks_of(spark, [("a", text_of(1))]), where)
    names = [p.name for p in Path(where.removeprefix("file:").replace("//", "/")).rglob("*.parquet") if "/chunks/" in str(p) or "/about/" in str(p)]
    assert index.stats()[0] and names and all(".zstd." in x for x in names)


def test_lists_are_sorted_in_their_batch():
    """Lists leave a batch in order of their terms, so a build sorts nothing but texts and a task doesn't hold all its lists."""
    tokens = [["pear", "fig", "pear"], [], ["apple", "fig"], None]
    batch = pa.RecordBatch.from_arrays([pa.array([4, 5, lexical.BLOCK, lexical.BLOCK + 1]), pa.array(tokens, pa.list_(pa.string()))], ["_num", "_t"])
    (lists,) = lexical._inverted(iter([batch]))
    assert [tuple(r.values()) for r in lists.to_pylist()] == [("apple", 1, [0], [1], [2]), ("fig", 0, [4], [1], [3]), ("fig", 1, [0], [1], [2]), ("pear", 0, [4], [2], [3])]


def test_evidence_of_hits_shuffles_no_documents(spark, sf_dir, capsys):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        queries()["evidence_backfill"](spark, sf_dir).explain()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in capsys.readouterr().out


def test_segments_and_edited_texts_shuffle_texts_once_at_most(spark, capsys):
    texts = spark.createDataFrame([("a", "x" * 25), ("b", "y" * 10), ("c", " ")], "file_id string, text string")
    segments = enrich.segments(texts, 10)
    assert [tuple(r) for r in segments.select("segment_id", "char_start", "char_end").where("file_id = 'a'").orderBy("ord").collect()] == [("seg-000001", 0, 10), ("seg-000002", 12, 22), ("seg-000003", 24, 29)]
    segments.explain()
    assert "Exchange" not in capsys.readouterr().out
    edits = spark.createDataFrame([("a", "seg-000002", "new"), ("b", "seg-000001", None), ("b", "seg-000009", "unknown"), ("d", "seg-000001", "other")], "file_id string, segment_id string, new_text string")
    edited = enrich.edited_texts(segments, edits)
    edited.explain()
    assert capsys.readouterr().out.count("Exchange") == 1
    assert sorted(map(tuple, edited.collect())) == [("a", "x" * 10 + "\n\nnew\n\n" + "x" * 5), ("b", "y" * 10)]
