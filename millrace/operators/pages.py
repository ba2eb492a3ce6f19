"""Pages to regions to text: a table function over pages whose source of boxes is a plug-in."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from millrace.functions import geometry
from millrace.functions.text import ordered_text, strip

#: the columns that the table function adds
REGION = StructType([
    StructField("region", IntegerType()), StructField("label", StringType()), StructField("text", StringType()), *(StructField(c, DoubleType()) for c in ("xmin", "ymin", "xmax", "ymax")),
    StructField("width", LongType()), StructField("height", LongType()), StructField("error", StringType()),
])
#: what a source of boxes finds on a page: its width and height in pixels, and boxes with type, text and bbox (shares of the page)
Found = tuple[int, int, list[dict[str, Any]]]


def page_function(boxes: Callable[[Any], Found], content: str = "content"):
    """A table function of pages: all their columns but the content, and a row for each box.

    A page without boxes is one row without a region; so is one that the source fails on, with the error. A box
    without a text or a place has nulls there.
    """

    class Regions:
        @staticmethod
        def analyze(pages: AnalyzeArgument) -> AnalyzeResult:
            kept = [f for f in pages.dataType.fields if f.name != content]
            return AnalyzeResult(schema=StructType([*kept, *REGION.fields]))

        def eval(self, row) -> Iterator[tuple]:
            kept = tuple(v for k, v in row.asDict().items() if k != content)
            try:
                width, height, found = boxes(row[content])
                made = []
                for i, box in enumerate(found):
                    at = box.get("bbox")
                    at = at if isinstance(at, dict) else {}
                    made.append((i, box.get("type"), box.get("text"), *(float(at.get(c) or 0.0) if at else None for c in ("xmin", "ymin", "xmax", "ymax")), int(width), int(height), None))
            except Exception as e:  # the page says what went wrong, the others go on
                yield (*kept, None, None, None, None, None, None, None, None, None, str(e)[:500] or type(e).__name__)
                return
            for region in made or [(None,) * 7 + (int(width), int(height), None)]:
                yield (*kept, *region)

    return F.udtf(Regions)


def page_regions(pages: DataFrame, boxes: Callable[[Any], Found], content: str = "content") -> DataFrame:
    """The regions of pages (any columns, and the content): see page_function. Pages are worked on where they lie, without a shuffle."""
    return page_function(boxes, content)(pages.asTable())


def pixel_boxes(regions: DataFrame) -> DataFrame:
    """The regions with x1, y1, x2, y2: their boxes in whole pixels, corners in order and inside the page; null without a place."""
    scaled = lambda c, size: F.col(c) * F.col(size)
    # toward zero, as pixels are counted
    whole = lambda c, size: F.when(scaled(c, size) < 0, F.ceil(scaled(c, size))).otherwise(F.floor(scaled(c, size)))
    box = geometry.ordered_box(whole("xmin", "width"), whole("ymin", "height"), whole("xmax", "width"), whole("ymax", "height"), F.col("width"), F.col("height"))
    return regions.withColumn("_b", F.when(F.col("xmin").isNotNull(), box)).select("*", "_b.x1", "_b.y1", "_b.x2", "_b.y2").drop("_b")


def read_pages(regions: DataFrame, doc: str = "doc_id", page: str = "page", stop: bool = True) -> DataFrame:
    """doc, page, segment_id, text, n_regions, n_pictures, error of each page that is kept.

    A page's text is that of its regions in order, stripped, blank ones left out, joined by blank lines; a picture
    is a region with that label and a box of some size. A page that failed has its error and no text. With
    `stop` the pages of a document end at the first that failed, as in a loop that gives up there; without
    it all others are kept. Equal pages of a document are one page.
    """
    placed = pixel_boxes(regions)
    text = strip(F.coalesce("text", F.lit("")))
    picture = (F.col("label") == "Picture") & (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))
    # a page is one row of the source: its regions are as many as one call returned
    read = placed.groupBy(doc, page).agg(
        ordered_text(F.col("region"), F.when(text != "", text)).alias("text"), F.count("region").alias("n_regions"), F.count(F.when(picture, 1)).alias("n_pictures"), F.max("error").alias("error"))
    if stop:
        first = read.where("error IS NOT NULL").groupBy(doc).agg(F.min(page).alias("_first"))
        read = read.join(first, doc, "left").where(F.col("_first").isNull() | (F.col(page) <= F.col("_first"))).drop("_first")
    return read.select(doc, page, F.format_string("seg-%06d", F.col(page)).alias("segment_id"), F.when(F.col("error").isNull(), F.col("text")).alias("text"), "n_regions", "n_pictures", "error")


def picture_names(regions: DataFrame, pages: DataFrame, doc: str = "doc_id", page: str = "page") -> DataFrame:
    """doc, page, artifact_id, x1, y1, x2, y2: the pictures of pages that were read, numbered through each document."""
    good = pages.where("error IS NULL").select(doc, page)
    some = pixel_boxes(regions).where("label = 'Picture' AND x2 > x1 AND y2 > y1").join(good, [doc, page], "left_semi")
    # numbers go on from page to page: counts of pages first, then the few of each page
    counts = some.groupBy(doc, page).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(doc).orderBy(page)) - F.col("_n"))
    n = F.row_number().over(Window.partitionBy(doc, page).orderBy("region")) + F.col("_before")
    return some.join(before, [doc, page]).select(doc, page, F.format_string("artifact-%06d", n).alias("artifact_id"), "x1", "y1", "x2", "y2")


def document_states(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, status (done, partial, error), pages_done, pages_tried, error: what became of each document."""
    ok = F.count(F.when(F.col("error").isNull(), 1))
    found = pages.groupBy(doc).agg(ok.alias("pages_done"), F.count(F.lit(1)).alias("pages_tried"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("segment_id"))).alias("error"))
    status = F.when(F.col("error").isNull(), "done").when(F.col("pages_done") > 0, "partial").otherwise("error")
    return found.select(doc, status.alias("status"), "pages_done", "pages_tried", "error")
