"""Snapshot tables: versions, scopes, failures half way, commits side by side."""

import uuid

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from millrace.session import shared_dir
from millrace.sources.snapshots import CommitConflict, SnapshotTable

KIND = "scope_type string, scope_id string, kind string, method string, written int, payload string"


@pytest.fixture
def store(spark):
    return SnapshotTable(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", buckets=4)


def rows(spark, *given):
    return spark.createDataFrame(list(given), KIND)


def held(store, **kw):
    return sorted((tuple(r) for r in store.read(**kw).collect()), key=repr)


def test_versions(spark, store):
    assert store.version() == 0
    with pytest.raises(AnalysisException):
        store.read()
    a = [("object", f"f{i}", "synthesis", "firstN", 1, f"text {i}") for i in range(9)] + [(None, None, "synthesis", "firstN", 1, None)]
    assert store.put(rows(spark, *a)) == 1
    assert held(store) == sorted(a, key=repr)
    # a name is replaced, another method is added, all else stays
    b = [("object", "f3", "synthesis", "firstN", 2, "new"), ("object", "f3", "synthesis", "wiki", 2, "w"), (None, None, "synthesis", "firstN", 2, "n")]
    assert store.put(rows(spark, *b)) == 2
    now = {r[:4]: r for r in a} | {r[:4]: r for r in b}
    assert held(store) == sorted(now.values(), key=repr)
    assert held(store, version=1) == sorted(a, key=repr)
    # a scope as a whole
    assert store.replace(rows(spark, ("object", "f3", "synthesis", "only", 3, "o"))) == 3
    assert [r for r in held(store) if r[1] == "f3"] == [("object", "f3", "synthesis", "only", 3, "o")]
    assert store.delete(spark.createDataFrame([("object", "f3"), ("object", "f4")], "scope_type string, scope_id string")) == 4
    assert {r[1] for r in held(store)} == {None, "f0", "f1", "f2", "f5", "f6", "f7", "f8"}
    assert store.delete(spark.createDataFrame([("object", "f5", "synthesis", "other")], "scope_type string, scope_id string, kind string, method string")) == 5
    assert len(held(store)) == 8
    assert {r[1] for r in held(store, scopes=rows(spark, ("object", "f1", None, None, None, None)))} == {"f1"}
    assert [r["op"] for r in store.history().orderBy("version").collect()] == ["put", "put", "replace", "delete", "delete"]
    with pytest.raises(ValueError):
        store.read(version=9)


def test_only_touched_buckets_are_written(spark, store):
    store.put(rows(spark, *[("object", f"f{i}", "k", "m", 1, "x") for i in range(40)]))
    before = {r["bucket"]: r["folder"] for r in store._listed().where("version = 1").collect()}
    assert len(before) == 4
    store.put(rows(spark, ("object", "f7", "k", "m", 2, "y")))
    after = {r["bucket"]: r["folder"] for r in store._listed().where("version = 2").collect()}
    assert sum(before[b] != after[b] for b in before) == 1
    store.put(rows(spark, *[("object", f"f{i}", "k", "m", 3, "z") for i in range(40)]))
    assert {r["folder"] for r in store.unused().collect()} == set(before.values()) | set(after.values())


def test_columns_of_rows_are_updated(spark, store):
    store.put(rows(spark, ("object", "a", "k", "m", 1, "x"), ("object", "b", "k", "m", 1, "y")))
    store.update(spark.createDataFrame([("object", "a", "k", "m", "wiki"), ("object", "zz", "k", "m", "none")], "scope_type string, scope_id string, kind string, method string, synthesizer string"))
    got = {r["scope_id"]: (r["payload"], r["synthesizer"]) for r in store.read().collect()}
    assert got == {"a": ("x", "wiki"), "b": ("y", None)}
    store.update(spark.createDataFrame([("object", "a", "k", "m", None)], "scope_type string, scope_id string, kind string, method string, payload string"))
    assert {r["scope_id"]: (r["payload"], r["synthesizer"]) for r in store.read().collect()} == {"a": (None, "wiki"), "b": ("y", None)}


def test_a_commit_that_fails_half_way_is_not_seen(spark, store):
    store.put(rows(spark, ("object", "a", "k", "m", 1, "x")))
    bad = rows(spark, ("object", "a", "k", "m", 2, "y"), ("object", "b", "k", "m", 2, "no number")).withColumn("written", F.when(F.col("scope_id") == "b", F.col("payload").try_cast("int")).otherwise(F.raise_error(F.lit("lost"))).cast("int"))
    with pytest.raises(Exception, match="lost"):
        store.put(bad)
    assert store.version() == 1
    assert held(store) == [("object", "a", "k", "m", 1, "x")]
    # data without a list: a commit whose driver died between the two
    rows(spark, ("object", "a", "k", "m", 5, "dead")).withColumn("bucket", store.bucket()).write.partitionBy("bucket").parquet(f"{store.path}/data/dead")
    assert held(store) == [("object", "a", "k", "m", 1, "x")]
    assert store.put(rows(spark, ("object", "b", "k", "m", 2, "y"))) == 2
    assert len(held(store)) == 2


def test_commits_side_by_side(spark, store):
    store.put(rows(spark, ("object", "a", "k", "m", 1, "x")))
    folders = {r["bucket"]: r["folder"] for r in store._listed().collect()}
    schema = store.read().schema
    store._publish(2, folders, "b" * 32, schema, "put")
    with pytest.raises(CommitConflict):
        store._publish(2, folders, "c" * 32, schema, "put")
    # two lists of one version: the same one holds for every reader, and the other commit learns it
    spark.createDataFrame([(0, "data/none", "a" * 32, schema.json(), "put")], "bucket int, folder string, commit string, schema string, op string").withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{store.path}/versions/version=2")
    assert store.history().where("version = 2").first()["commit"] == "a" * 32


def test_names_that_repeat_and_empty_changes(spark, store):
    twice = rows(spark, ("object", "a", "k", "m", 1, "x"), ("object", "a", "k", "m", 2, "y"))
    with pytest.raises(ValueError):
        store.put(twice)
    with pytest.raises(ValueError):
        store.delete(twice.select("scope_type", "scope_id"))
    store.put(twice, order="written")
    assert held(store) == [("object", "a", "k", "m", 2, "y")]
    store.put(twice.limit(0))
    assert held(store) == [("object", "a", "k", "m", 2, "y")]
    store.delete(twice.select("scope_type", "scope_id"))
    assert held(store) == []
    with pytest.raises(ValueError):
        SnapshotTable(spark, "x", scope=("a",), name=("b",))


def test_rows_of_a_put_are_made_once(spark, store):
    """What rows hold is made once, whether they are the first or meet others; names alone are looked at before."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def payload(scope_id):
        made.add(1)
        return f"payload of {scope_id}"

    given = rows(spark, *[("object", f"f{i}", "synthesis", "firstN", i, None) for i in range(10)]).withColumn("payload", payload("scope_id"))
    store.put(given, order="written")
    assert made.value == 10
    store.put(given.unionByName(rows(spark, ("object", "f3", "synthesis", "firstN", 99, "latest"))), order="written")
    assert made.value == 20
    assert {r[1]: r[5] for r in held(store)} == {f"f{i}": "latest" if i == 3 else f"payload of f{i}" for i in range(10)}
