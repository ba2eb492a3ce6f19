"""Bundles that are read back, and files that aren't what they should be."""

import json

from millrace.sources import bundles


def tree(root):
    for i in range(4):
        d = root / "objects" / f"sha256-{i}"
        d.mkdir(parents=True)
        (d / "meta.toml").write_text(f'[file]\nsource_relpath = "a/{i}.pdf"\nfilename = "{i}.pdf"\nmime = "application/pdf"\nsize_bytes = {i * 10}\nmtime_utc = 2026-05-21T00:00:00Z\n[hash]\nsha256 = "{i}"\n')
        (d / "manifest.jsonl").write_text("\n".join([json.dumps({"id": f"seg-{k:06d}", "ord": k, "kind": "text", "type": "page", "span": {"char_start": k, "char_end": k + 5}}) for k in range(1, i + 2)]) + "\n\n")
        (d / "text.txt").write_text(f"text of {i} é")
    (root / "objects" / "sha256-1" / "meta.toml").write_text("no = = toml")
    (root / "objects" / "sha256-2" / "manifest.jsonl").write_text('{"id": "seg-000001"}\nbroken\n{"ord": 3}\n')
    (root / "objects" / "sha256-3" / "text.txt").write_bytes(b"\xff\xfe\xfa")
    (root / "objects" / "sha256-3" / "provenance.toml").write_text('[provenance]\nstatus = "done"\n')
    return f"file://{root}"


def test_bundles(spark, tmp_path):
    root = tree(tmp_path)
    got = {r.file_id: r for r in bundles.objects(spark, root).collect()}
    assert set(got) == {f"sha256-{i}" for i in range(4)}
    assert (got["sha256-3"].source_relpath, got["sha256-3"].size_bytes, got["sha256-3"].mtime_utc, got["sha256-3"].sha256, got["sha256-3"].problem) == ("a/3.pdf", 30, "2026-05-21 00:00:00+00:00", "3", None)
    assert got["sha256-1"].source_relpath is None
    assert got["sha256-1"].problem == "meta.toml isn't TOML"
    lines = {(r.file_id, r.line): r for r in bundles.manifest(spark, root).collect()}
    assert len(lines) == 1 + 2 + 3 + 4
    assert [lines["sha256-2", n].problem for n in (1, 2, 3)] == [None, "the line isn't JSON", "the record has no id"]
    assert (lines["sha256-3", 4].id, lines["sha256-3", 4].ord, lines["sha256-3", 4].char_start, lines["sha256-3", 4].char_end) == ("seg-000004", 4, 4, 9)
    texts = {r.file_id: (r.text, r.problem) for r in bundles.texts(spark, root).collect()}
    assert texts["sha256-0"] == ("text of 0 é", None)
    assert texts["sha256-3"] == (None, "the text isn't UTF-8")


def test_some_bundles_and_none(spark, tmp_path):
    root = tree(tmp_path)
    assert {r.file_id for r in bundles.objects(spark, root, ["sha256-0", "sha256-2", "other"]).collect()} == {"sha256-0", "sha256-2"}
    many = ["sha256-0", *(f"x{i}" for i in range(bundles.LISTED + 5))]
    assert {r.file_id for r in bundles.objects(spark, root, many).collect()} == {"sha256-0"}
    assert bundles.objects(spark, root, []).count() == 0
    assert bundles.objects(spark, root, ["nothing"]).count() == 0
    assert bundles.records(spark, root, "synth.toml").count() == 0
    assert [r.file_id for r in bundles.records(spark, root, "provenance.toml").collect()] == ["sha256-3"]
    # only what fits the pattern is listed
    assert len(bundles.bundle_files(spark, root, "meta.toml", ["sha256-0"]).inputFiles()) == 1


def test_answers_of_models(spark):
    good = '[synthesis]\nsynthesis = "s"\ndoc_type = "report"\nquality = "high"\n[details]\ndescription = "d"\n'
    rows = [("plain", good), ("fenced", f"```toml\n{good}```"), ("prose", "  It seems " + "x" * 400), ("empty", " "), ("null", None), ("partly", '[synthesis]\nsynthesis = "only"\n')]
    got = {r.file_id: tuple(r)[1:] for r in bundles.answers_as_records(spark.createDataFrame(rows, "file_id string, raw string")).collect()}
    assert got["plain"] == got["fenced"] == ("s", "report", "high", "d", False)
    whole = "It seems " + "x" * 400
    assert got["prose"] == (whole[:300], "unknown", "low", whole, True)
    assert got["partly"] == ("only", None, None, None, False)
    # an empty text is TOML without anything in it
    assert got["empty"] == got["null"] == (None, None, None, None, False)
