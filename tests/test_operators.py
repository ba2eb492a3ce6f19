"""Cases that the shared tables don't hold."""

import os

import pytest
from pyspark.sql import functions as F

from millrace.functions import paths, text
from millrace.operators import catalog, chunking, enrich, graph, scopes
from millrace.plans import search
from millrace.sources import corpus
from millrace.streaming import publish


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


@pytest.mark.parametrize("raw, parts", [
    ("First.\n\nSecond one.", ["First.", "Second one."]),
    ("a\n\nbc", ["a\n\nbc"]),  # one character merges forward
    ("ends in blank  \n\nnext", ["ends in blank  \n\nnext"]),
    ("dropped at the end\n\nlast  ", ["dropped at the end"]),
    ("x\U0001f600y\n\nzw\n", ["x\U0001f600y", "zw"]),
])
def test_paragraphs(spark, raw, parts):
    rows = chunking.chunks(spark.createDataFrame([("f", raw)], ["file_id", "text"]), "paragraph").orderBy("chunk_index").collect()
    assert [r["text"] for r in rows] == parts
    assert all(raw[r["char_start"] : r["char_end"]] == r["text"] for r in rows)


def test_windows(spark):
    raw = "  " + "abcdefghij " * 40
    rows = chunking.chunks(spark.createDataFrame([("f", raw), ("g", "  \n"), ("h", None)], "file_id string, text string"), "window", 100, 20).orderBy("chunk_index").collect()
    assert all(raw[r["char_start"] : r["char_end"]] == r["text"] == r["text"].strip() for r in rows)
    assert [r["chunk_index"] for r in rows] == list(range(1, len(rows) + 1)) and {r["file_id"] for r in rows} == {"f"}
    with pytest.raises(ValueError):
        chunking.chunks(spark.createDataFrame([("f", raw)], ["file_id", "text"]), "other")


@pytest.mark.parametrize("path, suffix", [("x.TAR.GZ", ".gz"), (".bashrc", ""), ("a/noext", ""), ("b/.hid.txt", ".txt")])
def test_suffix(spark, path, suffix):
    assert one(spark, paths.suffix(F.col("p")), p=path) == suffix


def test_globs(spark):
    match = lambda p, g: one(spark, paths.matches_any(F.col("p"), g, True), p=p)
    assert match("dir/finished.PDF", ["*.pdf"]) and not match("experiments", ["experiments/**"]) and match("a/b/c.md", ["a/*.md"])
    assert match("anything", []) and match("x1", ["x[0-9]"]) and not match("xa", ["x[0-9]"])


def test_span_guards(spark):
    span = lambda a, b: one(spark, text.span(F.col("t"), F.lit(a).cast("bigint"), F.lit(b).cast("bigint")), t="héllo")
    assert span(1, 3) == "él" and span(2, 99) == "llo" and span(-1, 2) is None and span(3, 2) is None and span(9, 10) is None and span(None, 1) is None


def test_garbage(spark):
    bad = lambda t: one(spark, text.garbage_line(F.col("t")), t=t)
    assert bad("   ") and bad("x" * 700) and bad("12345") and bad("word aaaaaaaaaaaa end") and bad("brrrk tvntp skrtz mnpqr")
    assert not bad("A plain sentence.") and not bad("1, 2, 3, 4 kg 5")


def test_scopes(spark):
    o = spark.createDataFrame([("f1", "ab/x.txt", "t"), ("f2", "abc/y.txt", "t"), ("f3", "z.txt", "t")], ["file_id", "source_relpath", "text"])
    ids = lambda s, m=None: {r["file_id"] for r in scopes.in_scope(o, s, m).collect()}
    assert ids(scopes.Scope()) == {"f1", "f2", "f3"} and ids(scopes.Scope("folder", "ab")) == {"f1"} and ids(scopes.Scope("document", "f3")) == {"f3"}
    assert ids(scopes.Scope("folder", "none")) == set() and ids(scopes.Scope("object", "")) == set()
    members = spark.createDataFrame([("c", "f2"), ("d", "f1")], ["collection_id", "file_id"])
    assert ids(scopes.Scope("collection", "c"), members) == {"f2"}
    with pytest.raises(ValueError):
        scopes.Scope("planet")


def test_group_by_file(spark):
    hits = spark.createDataFrame([("a", "a.pdf", 1.0, "a-1"), ("a", "a.pdf", 5.0, "a-2"), ("b", "b.pdf", 3.0, "b-1")], ["file_id", "source_relpath", "score", "chunk_id"])
    assert [r["chunk_id"] for r in search.best_per_file(hits, 5).collect()] == ["a-2", "b-1"]
    with pytest.raises(ValueError):
        search.search(hits, "x", "odd")


def test_reconcile(spark):
    c = spark.createDataFrame([("same", "1"), ("edit", "2"), ("old", "3"), ("lost", "4")], ["source_relpath", "file_id"])
    s = spark.createDataFrame([("same", "1"), ("edit", "9"), ("fresh", "3"), ("added", "5")], ["source_relpath", "file_id"])
    got = {(r["source_relpath"], r["state"], r["moved_to"]) for r in catalog.reconcile(c, s).collect()}
    assert got == {("same", "unchanged", None), ("edit", "changed", None), ("old", "moved", "fresh"), ("lost", "missing", None), ("added", "new", None)}
    # content that is at a path the catalog knows has moved there, and changed paths say what they hold now
    s = spark.createDataFrame([("same", "1"), ("edit", "3"), ("copy", "3")], ["source_relpath", "file_id"])
    got = {(r["source_relpath"], r["state"], r["moved_to"], r["new_file_id"]) for r in catalog.reconcile(c, s).collect()}
    assert got == {("same", "unchanged", None, None), ("edit", "changed", None, "3"), ("old", "moved", "edit", None), ("lost", "missing", None, None)}


def test_budget_stops_at_the_first_too_large(spark):
    f = spark.createDataFrame([(1, 10), (2, 100), (3, 5)], "ord bigint, size bigint")
    assert [r["ord"] for r in catalog.within_budget(f, "ord", "size", 10, 50).collect()] == [1]
    assert catalog.within_budget(f, "ord", "size", 0, 500).count() == 0


def test_components(spark):
    import random

    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2200)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(pairs, "src bigint, dst bigint")).collect()}
    assert got == {x: find(x) for x in up}


@pytest.mark.parametrize("raw, target, most, parts", [
    ("short", 5, 9, ["short"]), ("  ", 5, 9, []), ("aaa\n\nbbb\n\nccc", 8, 10, ["aaa\n\nbbb", "ccc"]),
    ("one two three four", 8, 10, ["one two", "three", "four"]),  # three four is longer than the target
    ("x" * 25, 8, 10, ["x" * 10, "x" * 10, "x" * 5]), ("abcdefghij klm", 4, 6, ["abcdef", "ghij", "klm"]),
    ("first. second. third", 9, 12, ["first", "second", "third"]), ("aa\nbb\n\n" + "y" * 13, 5, 6, ["aa\nbb", "y" * 6, "y" * 6, "y"]),
])
def test_split_golden(raw, target, most, parts):
    assert enrich.split_to_fit(raw, target, most) == parts


def test_fold_keeps_all(spark):
    rows = [(s, i, f"{s}{i}") for s, n in (("a", 1), ("b", 8), ("c", 70)) for i in range(n)]
    got = {r["scope_id"]: r["text"] for r in enrich.folded(spark.createDataFrame(rows, "scope_id string, ord int, text string"), 8).collect()}
    assert got == {s: "\n\n".join(t for x, _, t in rows if x == s) for s in "abc"}


def test_joined_first_n(spark):
    rows = [("a", 5000 * i, t) for i, t in enumerate(["", " x  y ", "one\r\ntwo", "three " * 9, "four"])]
    parts = spark.createDataFrame(rows, "scope_id string, ord bigint, text string")
    for n in (3, 4, 12, 30, 500):
        whole = " x  y \n\none\r\ntwo\n\n" + "three " * 9 + "\n\nfour"
        plain = whole.replace("\r\n", "\n").replace("  ", " ").replace(" \n", "\n").strip()[:n].strip()
        assert enrich.joined_first_n(parts, n).first()["text"] == plain


def test_answers(spark):
    hits = spark.createDataFrame([(1, " told ", "a/b.txt", "f"), (2, "  ", "c", "g"), (3, "more", "", "h")], "rank int, snippet string, source_relpath string, file_id string")
    said = enrich.extractive_answer(hits).first()["answer"]
    assert "\n\n- told [b.txt]\n- more [h]\n\n" in said
    assert enrich.extractive_answer(hits.where("rank = 2")).first()["answer"] == enrich.NO_ANSWER


@pytest.mark.parametrize("width, height, asked, mode", [(160, 40, "auto", 7), (159, 40, "auto", 7), (120, 80, "auto", 8), (200, 80, "auto", 7), (200, 81, "auto", 6), (10, 10, "11", 11)])
def test_layouts(spark, width, height, asked, mode):
    from millrace.functions import geometry

    assert one(spark, geometry.segmentation_mode(F.col("w"), F.col("h"), F.col("a")), w=width, h=height, a=asked) == mode


def test_html(spark):
    page = "<html><head><title>t</title></head><body><script>x()</script><p>One &amp; two</p><!-- no --><div>a <b>bold</b>&nbsp;word</div></body></html>"
    assert one(spark, corpus.html_text(F.col("h")), h=page) == "One & two\na bold word"


def test_hits_are_decorated_and_filled(spark, tmp_path):
    rows = [(f"c{i}", f"f{i // 2}", f"d/x{i // 2}.txt", i % 2 + 1, 0, 9, "alpha beta" if i < 3 else "gamma") for i in range(8)]
    chunks = spark.createDataFrame(rows, "chunk_id string, file_id string, source_relpath string, chunk_index int, char_start int, char_end int, text string")
    members = spark.createDataFrame([("k", "Zed", "f0", 1), ("l", "amy", "f0", 2)], "collection_id string, name string, file_id string, created int")
    hits = search.search(chunks, "alpha", top_k=5, include_zero=True, members=members).collect()
    assert [r["chunk_id"] for r in hits[:3]] == ["c0", "c1", "c2"] and [r["score"] for r in hits[3:]] == [0.0, 0.0]
    assert {(r["file_id"], r["filename"], r["collections"]) for r in hits[:3]} == {("f0", "x0.txt", "amy,Zed"), ("f1", "x1.txt", None)}
    index = search.build(chunks, str(tmp_path / "index"))
    again = search.search(index, "alpha", top_k=5, scope=scopes.Scope("collection", "k"), members=members).collect()
    assert [r["chunk_id"] for r in again] == ["c0", "c1"] and again[0]["snippet"] == "alpha beta" and again[0]["score"] == pytest.approx(hits[0]["score"])


def test_missing_parts_are_told(spark):
    from millrace.operators import artifacts

    docs = spark.createDataFrame([(1, "Some text here", "a.txt")], "doc_id bigint, text string, filename string")
    assert artifacts.synthesize(docs, "first_lines").first()["text"] == "## a.txt\n\nSome text here"
    for run in (lambda: artifacts.synthesize(docs, "none"), lambda: artifacts.run_enricher(docs, "none", "root", "root")):
        with pytest.raises(ValueError):
            run()


def test_split_to_fit():
    parts = enrich.split_to_fit("para one. more\n\npara two\nline " + "x" * 50, 20, 30)
    assert all(len(p) <= 30 for p in parts) and enrich.split_to_fit("", 5, 5) == []


def test_files_and_lines(spark, tmp_path):
    import zipfile

    (tmp_path / "a.txt").write_text("plain text")
    (tmp_path / "b.rtf").write_text(r"{\rtf1 hello}")
    (tmp_path / "c.bin").write_bytes(b"\x00")
    (tmp_path / "d.docx").write_bytes(b"broken")
    with zipfile.ZipFile(tmp_path / "e.pptx", "w") as z:
        z.writestr("ppt/slides/slide1.xml", "<a><t>One</t><t> two </t></a>")
        z.writestr("ppt/slides/slide2.xml", "<a><t>cut")
    got = {os.path.basename(r["path"]): (r["status"], (r["text"] or "").strip()) for r in corpus.extracted(corpus.files(spark, str(tmp_path))).collect()}
    assert got == {"a.txt": ("done", "plain text"), "b.rtf": ("done", "hello"), "c.bin": ("unsupported", ""), "d.docx": ("error", ""), "e.pptx": ("done", "One two")}
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    good, bad = corpus.json_lines(spark, str(tmp_path / "l.jsonl"), "a int")
    assert sorted(r["a"] for r in good.collect()) == [1, 2] and bad.count() == 1
    assert tuple(corpus.line_counts(good, bad).first()) == (2, 1)


def test_publication_is_incremental(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    spark.range(5).write.parquet(src)
    for more in (0, 3):
        if more:
            spark.range(100, 100 + more).write.mode("append").parquet(src)
        publish.publish(publish.arriving(spark, src, "id bigint"), out, mark).awaitTermination()
        assert spark.read.parquet(out).count() == 5 + more


def test_index_equals_the_scan(spark, tmp_path):
    from millrace.operators import lexical

    rows = [(f"c{i}", " ".join(["alpha", "beta", "gamma"][j % 3] for j in range(i % 7)) + " delta" * (i % 3)) for i in range(60)]
    chunks = spark.createDataFrame(rows, ["chunk_id", "text"])
    lexical.build_index(chunks, str(tmp_path / "x"))
    for q in ("alpha delta", "beta beta", "nothing", ""):
        a = [(r["chunk_id"], round(r["score"], 9)) for r in lexical.bm25(chunks, q, 10).collect()]
        b = [(r["chunk_id"], round(r["score"], 9)) for r in lexical.search_index(spark, str(tmp_path / "x"), q, 10).collect()]
        assert a == b


def test_embedding_retries_shortens_and_resumes(spark):
    from millrace.operators import embedding

    def client(texts):
        if any(len(t) > 600 for t in texts):
            raise embedding.TooLong
        if any("bad" in t for t in texts):
            raise RuntimeError("no")
        return embedding.toy_client(texts)

    chunks = spark.createDataFrame([("a", "fine"), ("b", "x" * 900), ("c", "bad"), ("d", " "), ("e", "done before")], ["chunk_id", "text"]).coalesce(1)
    rows = {r["chunk_id"]: r for r in embedding.embed(chunks, client, chunks.where("chunk_id = 'e'"), wait=0.0).collect()}
    assert set(rows) == {"a", "b", "c"} and rows["c"]["status"] == "no" and rows["c"]["embedding"] is None
    assert rows["a"]["embedding"] == embedding.toy_client(["fine"])[0] and rows["b"]["embedding"] == embedding.toy_client(["x" * 512])[0]


def test_first_n_of_texts_that_are_cleaned_in_part(spark):
    """Cuts inside runs of white space, of any kind of line end, and texts that shrink below the cut."""
    odd = [" \r" * 70 + "a\r\n" * 90, "x" * 119 + "\r\n" * 9 + "tail", "y" * 119 + " " * 300 + "z", "\u00a0" * 200 + "b " * 99, "w" * 9 + "\n" * 500 + "end", "é\t😀 " * 80, "short", "", None, " " * 400]
    odd += ["q" * k + " \r\n\n \n" * 3 + "r" * 200 for k in range(5, 14)]
    texts = spark.createDataFrame(list(enumerate(odd)), "doc_id int, text string")
    want = texts.withColumn("text", text.strip(F.left(text.light_clean(F.col("text")), F.lit(10))))
    assert sorted(map(tuple, enrich.first_n(texts, 10).collect())) == sorted(map(tuple, want.collect()))


def test_snippet_equals_its_sql_on_odd_texts(spark, tmp_path):
    """Empty texts, missing ones, and white space of any kind where the texts are cut."""
    import duckdb

    from millrace import catalogue

    odd = ["", None, " \t\n\r\x0b\x0c", "\u00a0", "\u3000x\u2003 ", "\n\x85y\x1c\t", "a" * 239 + "\u00a0" + "b" * 159 + "\u2028" + "c", "d" * 238 + " \n" + "e" * 158 + "\t ", "\U0001f600" * 401, " " * 400 + "f", "\ufeffg\u200b", "\x00h\x00"]
    spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(f"SELECT doc_id, snippet, preview FROM ({catalogue.oracle_sql()['snippet']})").fetchall()
    got = catalogue.queries()["snippet"](spark, str(tmp_path)).select("doc_id", "snippet", "preview").collect()
    assert sorted(map(tuple, got)) == sorted(want)
