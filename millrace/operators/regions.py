"""What is relational in reading page images: regions, their order, and the text of a page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import ordered_text, strip


def usable_regions(regions: DataFrame, least_area: float, least_width: int, least_height: int) -> DataFrame:
    """Regions (area, width, height, page_width, page_height) that are large enough and not the page itself."""
    whole = (F.col("width") > F.floor(F.col("page_width") * 0.98)) & (F.col("height") > F.floor(F.col("page_height") * 0.98))
    return regions.where((F.col("area") >= least_area) & (F.col("width") >= least_width) & (F.col("height") >= least_height) & ~whole)


def in_reading_order(regions: DataFrame, most: int, page: str = "page") -> DataFrame:
    """The first `most` regions of each page, from top to bottom and left to right (y, x, region_id), with their rank."""
    order = Window.partitionBy(page).orderBy("y", "x", "region_id")
    return regions.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= most)


def region_texts(words: DataFrame, region: str = "region_id") -> DataFrame:
    """region, text, confidence: non-blank words (ord, text, conf in percent; below 0: unknown) joined by blanks.

    The confidence is the mean of the known ones between 0 and 1, 1 where none is known, 0 without text.
    """
    t = strip(F.coalesce("text", F.lit("")))
    known = F.when((t != "") & (F.col("conf") >= 0), F.col("conf") / 100.0)
    joined = words.groupBy(region).agg(ordered_text(F.col("ord"), F.when(t != "", t), " ").alias("text"), F.avg(known).alias("c"))
    return joined.select(region, "text", F.when(F.col("text") == "", 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("c", F.lit(1.0))))).alias("confidence"))


def read_regions(texts: DataFrame, least: float) -> DataFrame:
    """Those with a text and enough confidence."""
    return texts.where((strip(F.coalesce("text", F.lit(""))) != "") & (F.col("confidence") >= least))
