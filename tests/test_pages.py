"""Pages to regions to text against a plain loop that gives up where a page fails."""

import json

import pytest

from millrace.operators import pages


def source(content):
    """A page is JSON that a model answered: a list of boxes, or a list with that list in it."""
    data = json.loads(content)
    boxes = data["boxes"]
    if isinstance(boxes, list) and len(boxes) == 1 and isinstance(boxes[0], list):
        boxes = boxes[0]
    if not isinstance(boxes, list):
        raise ValueError(f"no list of boxes on {data['n']}")
    return data["w"], data["h"], boxes


def made():
    box = lambda t, text, *b: {"type": t, "text": text, "bbox": dict(zip(("xmin", "ymin", "xmax", "ymax"), b, strict=True)) if b else None}
    rows = []
    for doc in range(6):
        for page in range(1, 6):
            boxes = [box("Text", f" doc {doc} ", 0.1, 0.1, 0.9, 0.2), box("Text", None, 0, 0, 1, 1), box("Text", "  "), box("Picture", f"page {page}", 0.8, 0.9, 0.2, -0.5), box("Picture", "flat", 0.5, 0.5, 0.5, 0.9), box("Picture", "far", 0.5, 0.5, 1.7, 2)]
            boxes = [boxes] if page == 2 else [] if page == 3 else boxes[: 1 + page]
            content = json.dumps({"n": page, "w": 100, "h": 77, "boxes": boxes})
            if (doc, page) in {(1, 4), (1, 2), (2, 1), (3, 5)}:
                content = json.dumps({"n": page, "w": 1, "h": 1, "boxes": "none"}) if doc == 1 else "broken" if doc == 2 else None
            rows.append((doc, page, content, "kept"))
    return rows


def plain(rows, stop):
    out, states, pictures = [], {}, []
    for doc in sorted({r[0] for r in rows}):
        done, tried, error, n = 0, 0, None, 0
        for _, page, content, _ in sorted(r for r in rows if r[0] == doc):
            tried += 1
            try:
                w, h, boxes = source(content)
            except Exception as e:
                error = error or str(e)
                out.append((doc, page, f"seg-{page:06d}", None, 0, 0, str(e)))
                if stop:
                    break
                continue
            done += 1
            texts, here = [], 0
            for b in boxes:
                if (b["text"] or "").strip():
                    texts.append(b["text"].strip())
                if b["type"] == "Picture" and b["bbox"]:
                    x1, x2 = sorted((int(b["bbox"]["xmin"] * w), int(b["bbox"]["xmax"] * w)))
                    y1, y2 = sorted((int(b["bbox"]["ymin"] * h), int(b["bbox"]["ymax"] * h)))
                    x1, x2, y1, y2 = (max(0, min(m, v)) for v, m in ((x1, w), (x2, w), (y1, h), (y2, h)))
                    if x2 > x1 and y2 > y1:
                        n, here = n + 1, here + 1
                        pictures.append((doc, page, f"artifact-{n:06d}", x1, y1, x2, y2))
            out.append((doc, page, f"seg-{page:06d}", "\n\n".join(texts), len(boxes), here, None))
        states[doc] = ("done" if error is None else "partial" if done else "error", done, tried, error)
    return out, states, pictures


@pytest.mark.parametrize("stop", [True, False])
def test_pages_equal_a_loop(spark, stop):
    rows = made()
    table = spark.createDataFrame(rows, "doc_id int, page int, content string, extra string").repartition(3)
    regions = pages.page_regions(table, source).cache()
    assert "extra" in regions.columns
    assert "content" not in regions.columns
    read = pages.read_pages(regions, stop=stop)
    out, states, pictures = plain(rows, stop)
    assert sorted(map(tuple, read.collect())) == out
    assert {r.doc_id: tuple(r)[1:] for r in pages.document_states(read).collect()} == states
    assert {s[0] for s in states.values()} == ({"done", "partial", "error"} if stop else {"done", "partial"})
    assert sorted(map(tuple, pages.picture_names(regions, read).collect())) == pictures


def test_no_pages(spark):
    none = spark.createDataFrame([], "doc_id int, page int, content string")
    read = pages.read_pages(pages.page_regions(none, source))
    assert read.count() == 0
    assert pages.document_states(read).count() == 0
