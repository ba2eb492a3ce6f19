"""Answers of processors, needles in segments and many questions against plain versions."""

import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from millrace.operators import contract, grams
from millrace.operators.scopes import Scope
from millrace.plans import batch
from millrace.plans import search as plans
from millrace.session import shared_dir
from tests.test_index import chunks_of, text_of


def artifact(**more):
    return {"id": "a", "kind": "k", "media_type": "m"} | more


TABLE = {"artifact_type": "table", "title": "t", "columns": [{"key": "a"}], "rows": [{"a": 1}, {"a": 2}]}
CASES = [
    (artifact(), "an artifact has exactly one payload"), (artifact(text=None, json_data=None), "an artifact has exactly one payload"), (artifact(text="x", data_base64="eA=="), "an artifact has exactly one payload"),
    (artifact(standard_data=TABLE), None), (artifact(standard_data=TABLE | {"row_provenance": [[]]}), "row_provenance doesn't match the rows"), (artifact(standard_data=TABLE | {"row_provenance": [[], [{"page": 1}]]}), None),
    (artifact(standard_data={"artifact_type": "poem"}), "unknown format of standard data"), (artifact(standard_data={"title": "no type"}), "unknown format of standard data"),
    (artifact(standard_data={"artifact_type": "knowledge_graph", "nodes": [{"id": "n"}, {"id": "n"}], "edges": []}), "ids of nodes repeat"),
    (artifact(standard_data={"artifact_type": "knowledge_graph", "nodes": [{"id": "n"}], "edges": [{"id": "e", "source": "n", "target": "n"}] * 2}), "ids of edges repeat"),
    (artifact(standard_data={"artifact_type": "entity_list", "entities": [{"id": 1}, {"id": 1}]}), "ids of entities repeat"),
    ({"id": "a", "kind": None, "media_type": "m", "text": "x"}, "id, kind and media_type are required"), (artifact(json_data={"x": None}), "an enrichment has standard data"), (artifact(json_data=0), "an enrichment has standard data"),
]


def test_artifacts(spark):
    rows = [(i, json.dumps({"api_version": "v1", "artifacts": [a]})) for i, (a, _) in enumerate(CASES)] + [(98, None), (99, json.dumps({"api_version": "v1", "artifacts": "none"}))]
    answers = contract.parsed(spark.createDataFrame(rows, "request_id int, body string"))
    got = {r.request_id: r.problem for r in contract.response_problems(answers).collect()}
    assert got == {i: p for i, (_, p) in enumerate(CASES) if p} | {98: "the body isn't JSON", 99: "no artifacts"}
    # of other kinds of processors any payload is one, and no artifact is needed
    loose = {r.request_id: r.problem for r in contract.response_problems(answers, enrichment=False).collect()}
    assert loose == {i: p for i, (_, p) in enumerate(CASES) if p and "enrichment" not in p} | {98: "the body isn't JSON"}
    assert "artifact_type: STRING" in contract.payload_schema(answers.where("request_id IN (3, 5)"))


def test_payloads_that_are_stored(spark):
    body = {"api_version": "v1", "artifacts": [artifact(text="just text"), artifact(id="", json_data=[1, None]), artifact(id="s", kind="", standard_data=TABLE)]}
    answers = contract.parsed(spark.createDataFrame([("r", "root", "root", "p", "1", "u", None, json.dumps(body))], "request_id string, scope_type string, scope_id string, processor string, version string, url string, written timestamp, body string"))
    none = contract.response_problems(answers).limit(0)
    got = {r.method: (r.kind, json.loads(r.payload), json.loads(r.metadata)["artifact_id"]) for r in contract.stored_artifacts(answers, none).collect()}
    assert got == {"p.a": ("k", {"text": "just text"}, "a"), "p.2": ("k", [1, None], ""), "p.s": ("enrichment", TABLE, "s")}


def test_needles(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdäéÄ B.\n😀") for _ in range(rng.randint(0, 60))) for _ in range(200)] + [None, "", "only this ONE has İt"]
    segments = spark.createDataFrame([(f"f{i % 7}", f"s{i}", t) for i, t in enumerate(texts)], "file_id string, segment_id string, text string")
    path = f"{shared_dir(spark)}/grams-test-{uuid.uuid4().hex}"
    grams.write_grams(segments, path)
    needles = ["ab", "A", "äé", " only THIS one ", "zzz", "", "  ", None, "b.\n", "😀", "😀a"] + [t[k : k + n] for t in texts[:25] if t for k, n in ((3, 3), (5, 4), (0, 9), (1, 40))]
    asked = spark.createDataFrame(list(enumerate(needles)), "needle_id int, needle string")
    got = sorted((r.needle_id, r.segment_id) for r in grams.find(spark, path, asked).collect())
    strip = lambda n: n.strip(" \t\n\r\x0b\x0c").lower()
    want = sorted((i, f"s{j}") for i, n in enumerate(needles) if n and strip(n) for j, t in enumerate(texts) if t and strip(n) in t.lower())
    assert got == want


def test_lists_of_grams_hold_numbers_alone(spark):
    """What a task holds is bounded: lists name segments by numbers, block by block, and every row is found, of equal keys too."""
    texts = [f"common {'abc' if i % 3 else 'ABD'} only{i}" for i in range(50)] + [None, "ab", "common abc"]
    segments = spark.createDataFrame([("same", "s", t) for t in texts], "file_id string, segment_id string, text string").repartition(3)
    path = f"{shared_dir(spark)}/grams-test-{uuid.uuid4().hex}"
    grams.write_grams(segments, path, block=4)
    lists = spark.read.parquet(f"{path}/postings")
    assert lists.columns == ["gram", "block", "places"]
    assert lists.agg(F.max(F.size("places"))).first()[0] <= 4
    assert lists.where("gram = 'com'").agg(F.sum(F.size("places"))).first()[0] == 51
    assert lists.groupBy("gram", "block").count().where("count > 1").isEmpty()
    asked = spark.createDataFrame(list(enumerate(("common abc", "abd", "only7", "ab", "none"))), "needle_id int, needle string")
    got = {r.needle_id: r["count"] for r in grams.find(spark, path, asked).groupBy("needle_id").count().collect()}
    low = [(t or "").lower() for t in texts]
    assert got == {i: n for i, q in enumerate(("common abc", "abd", "only7", "ab", "none")) if (n := sum(q in t for t in low))}


@pytest.fixture(scope="module")
def index(spark):
    return plans.build(chunks_of(spark, [(f"f{i:02d}", text_of(i)) for i in range(30)]), f"{shared_dir(spark)}/many-{uuid.uuid4().hex}", shards=4)


def test_many_questions_equal_single_searches(spark, index):
    asked = ["alpha only3", "beta beta gamma", "only7 only8 only9", "nothing here at all", "", "kappa", "v0"]
    questions = spark.createDataFrame(list(enumerate(asked)), "question_id int, text string")
    for scope in (Scope(), Scope("folder", "src/f03")):
        got = {}
        for r in batch.search_many(index, questions, 7, scope).collect():
            got.setdefault(r.question_id, []).append((r["rank"], r.chunk_id, round(r.score, 9), r.text, r.snippet, r.filename))
        for i, q in enumerate(asked):
            single = [(k, r.chunk_id, round(r.score, 9), r.text, r.snippet, r.filename) for k, r in enumerate(plans.search(index, q, top_k=7, scope=scope).collect(), 1)]
            assert sorted(got.get(i, [])) == single, q


def test_fallback_and_evidence(spark, index):
    questions = spark.createDataFrame([(1, "only3 only5"), (2, "only5"), (3, "unknown")], "question_id int, text string")
    hits = batch.search_with_fallback(index, questions, Scope("folder", "src/f03"), Scope(), 5)
    used = {(r.question_id, r.used) for r in hits.select("question_id", "used").collect()}
    assert used == {(1, "preferred"), (2, "fallback")}
    made = {r.question_id: (r.evidence, r.n_sources) for r in batch.evidence(hits, most=2, size=9).collect()}
    assert set(made) == {1, 2}
    assert made[2][0].startswith("[1] src/f05\n")
    assert all(len(line) <= 9 for e, _ in made.values() for line in e.split("\n") if line and not line.startswith("["))
    assert hits.where(F.col("used") == "preferred").where(~F.col("source_relpath").startswith("src/f03")).isEmpty()
