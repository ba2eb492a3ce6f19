"""Keywords, entities, tables, summaries and artifacts."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import SPACE, keyword_tokens, light_clean, ordered_text, strip
from millrace.operators.ranks import placed
from millrace.session import materialize

#: fixed values: words that are no keywords
STOP = (
    "the and for are with that this from into was were have has had but not you your their they them his her its our out all any can may will would should could about there which when what where while than then also such using used use these those within over under "
    "after before between because being been each other some more most only very onto upon report document"
).split()


def top_keywords(texts: DataFrame, top_k: int = 20, min_count: int = 1, order: str = "doc_id") -> DataFrame:
    """keyword, count of the most frequent keywords; ties by where they came first."""
    tokens = texts.select(order, F.posexplode(keyword_tokens(F.col("text"))).alias("pos", "keyword")).where(~F.col("keyword").isin(*STOP))
    counted = tokens.groupBy("keyword").agg(F.count(F.lit(1)).alias("count"), F.min(F.struct(order, "pos")).alias("_first")).where(F.col("count") >= min_count)
    return counted.orderBy(F.desc("count"), "_first").limit(top_k).select("keyword", "count")


def capitalised_phrases(texts: DataFrame) -> DataFrame:
    """entity_id, entity: distinct phrases of words that start with a capital, numbered in order.

    A word is of ASCII letters and stands by itself: no letter, digit or _ of any script next to it. The
    numbers come from counts of first characters and a window in each, so no task orders them all.
    """
    word = r"[A-Z][A-Za-z]+"
    form = rf"(?<![\p{{L}}\p{{N}}\p{{M}}_]){word}(?: {word})*(?![\p{{L}}\p{{N}}\p{{M}}_])"
    found = texts.select(F.explode(F.regexp_extract_all("text", F.lit(form), F.lit(0))).alias("entity")).distinct().withColumn("_head", F.left("entity", F.lit(2)))
    heads = found.groupBy("_head").agg(F.count(F.lit(1)).alias("n"))
    before = heads.select("_head", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("_head")) - F.col("n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_head").orderBy("entity")) + F.col("_before")
    return found.join(before, "_head").select(F.concat(F.lit("entity-"), place.cast("string")).alias("entity_id"), "entity")


def table_rows(texts: DataFrame, key: str = "doc_id", delimiter: str = "|", least: int = 2) -> DataFrame:
    """key, line_number (from 1) and cells of the lines that are table rows: enough cells and none empty."""
    cells = F.transform(F.split("line", "\\" + delimiter), lambda c: strip(F.regexp_replace(c, f"{SPACE}+", " ")))
    rows = texts.select(key, F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("cells", cells)
    return rows.where((F.size("cells") >= least) & F.forall("cells", lambda c: c != "")).select(key, (F.col("i") + 1).cast("bigint").alias("line_number"), "cells")


def segments(texts: DataFrame, size: int = 4000, key: str = "file_id", between: int = 2) -> DataFrame:
    """Segments of texts and their spans in the text that joins them with blank lines.

    All segments but the last have `size` characters, so a place says where its segment starts, and nothing is shuffled.
    """
    from millrace.functions.text import fixed_chunks

    rows = texts.select(key, F.posexplode(fixed_chunks(F.col("text"), size)).alias("i", "text"))
    start = F.col("i").cast("bigint") * (size + between)
    return rows.select(key, F.format_string("seg-%06d", F.col("i") + 1).alias("segment_id"), (F.col("i") + 1).cast("bigint").alias("ord"), start.alias("char_start"), (start + F.length("text")).cast("bigint").alias("char_end"), "text")


def edited_texts(segs: DataFrame, edits: DataFrame, key: str = "file_id") -> DataFrame:
    """key, text: segments with their edits (key, segment_id, new_text) in place, joined by blank lines and stripped."""
    none = F.lit(None).cast("string")
    own = segs.select(key, "segment_id", "ord", "text", none.alias("new_text"), F.lit(False).alias("_edit"))
    new = edits.where(F.col(key).isNotNull() & F.col("segment_id").isNotNull()).select(key, "segment_id", F.lit(None).cast(segs.schema["ord"].dataType).alias("ord"), none.alias("text"), "new_text", F.lit(True).alias("_edit"))
    # segments and edits meet where the text is gathered, so texts are shuffled once
    met = own.unionByName(new).repartition(key).withColumn("_new", F.collect_list(F.when(F.col("_edit"), F.struct("new_text"))).over(Window.partitionBy(key, "segment_id")))
    merged = met.where("NOT _edit").select(key, "ord", "text", F.explode_outer("_new").alias("_n")).withColumn("_t", F.coalesce("_n.new_text", "text"))
    return merged.groupBy(key).agg(strip(ordered_text(F.col("ord"), F.col("_t"))).alias("text"))


def preferred_texts(canonical: DataFrame, edited: DataFrame, key: str = "file_id") -> DataFrame:
    """key, representation, text: the edited text where there is one, else the canonical one."""
    e = edited.select(key, F.col("text").alias("_e"))
    return canonical.select(key, "text").join(e, key, "left").select(key, F.when(F.col("_e").isNotNull(), "edited").otherwise("canonical").alias("representation"), F.coalesce("_e", "text").alias("text"))


def first_n(texts: DataFrame, n: int = 4000) -> DataFrame:
    """The first n characters of each text after light cleaning, stripped.

    Cleaning changes runs of white space alone, so what is left of a beginning begins the whole text cleaned: where it
    has n characters, the rest needn't be cleaned.
    """
    text, size = F.col("text"), 2 * n + 100
    begun = light_clean(F.left(text, F.lit(size)))
    cleaned = F.when(F.length(begun) >= n, begun).otherwise(light_clean(text))
    return texts.withColumn("text", strip(F.left(cleaned, F.lit(n))))


def joined_first_n(parts: DataFrame, n: int = 4000, scope: str = "scope_id", order: str = "ord") -> DataFrame:
    """scope, text: the texts of a scope in order (integers), joined by blank lines, cleaned and cut to n characters.

    What can't reach the first n characters isn't gathered: lengths after cleaning are added up by blocks
    of the order, then inside the block where n is reached, and the parts after that are left out.
    """
    some = parts.where(strip(F.coalesce("text", F.lit(""))) != "")
    sized = some.withColumn("_size", F.length(light_clean(F.col("text"))).cast("bigint")).withColumn("_block", F.shiftright(F.col(order).cast("bigint"), 10))
    blocks = sized.groupBy(scope, "_block").agg(F.sum("_size").alias("_sum"))
    upto = Window.partitionBy(scope).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_sum").over(upto), F.lit(0))).where(F.col("_before") < n).drop("_sum")
    inside = Window.partitionBy(scope, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    few = sized.join(blocks, [scope, "_block"]).withColumn("_upto", F.col("_before") + F.coalesce(F.sum("_size").over(inside), F.lit(0))).where(F.col("_upto") < n)
    whole = few.groupBy(scope).agg(strip(ordered_text(F.col(order), F.col("text"))).alias("text"))
    return whole.select(scope, strip(F.left(light_clean(F.col("text")), F.lit(n))).alias("text"))


def bottom_up(tree: DataFrame, direct: DataFrame, combine: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """path, text of every folder, deepest first: a folder's text comes from those of its child folders, by
    path, and then from its own documents.

    tree holds path, parent_path and depth; direct holds path, ord and text of documents, ord not
    negative. combine maps rows of scope_id, ord and text to one text a scope. One round a level.
    """
    levels = sorted((r["depth"] for r in tree.select("depth").distinct().collect()), reverse=True)
    done, below = None, None
    for depth in levels:
        own = tree.where(F.col("depth") == depth).select("path")
        parts = direct.join(own, "path", "left_semi").select(F.col("path").alias("scope_id"), "ord", "text")
        if below is not None:
            # children in order of path, before the documents
            place = F.row_number().over(Window.partitionBy("parent_path").orderBy(F.desc("path")))
            kids = below.join(tree.select("path", "parent_path"), "path").select(F.col("parent_path").alias("scope_id"), (-place).cast("bigint").alias("ord"), "text")
            parts = parts.withColumn("ord", F.col("ord").cast("bigint")).unionByName(kids)
        below = materialize(combine(parts).select(F.col("scope_id").alias("path"), "text"), "folder-texts")
        done = below if done is None else done.unionByName(below)
    return done


def inventory_sentence(tree: DataFrame, name: str) -> DataFrame:
    """path, sentence: what a folder holds, in words."""
    def some(n, one, many):
        return F.concat(n.cast("string"), F.when(n == 1, f" {one}").otherwise(f" {many}"))

    shown = F.when(F.col("path") == "", name).otherwise(F.element_at(F.split("path", "/"), -1))
    files, folders = some(F.col("file_count"), "direct document", "direct documents"), some(F.col("subfolder_count"), "direct subfolder", "direct subfolders")
    return tree.select("path", F.concat(shown, F.lit(" contains "), files, F.lit(" and "), folders, F.lit(".")).alias("sentence"))


def folded(texts: DataFrame, group: int, combine: Callable[[DataFrame], DataFrame] | None = None, key: str = "scope_id", order: str = "ord") -> DataFrame:
    """Fold the texts of each key, `group` neighbours at a time, until one is left: ceil(log n) rounds.

    combine maps (key, ord, text) rows of one round to shorter ones, such as a model's summaries. No task
    orders a whole key; a round joins the texts of `group` neighbours.
    """
    rows = placed(texts.select(key, order, "text"), [key], [order]).select(key, F.col("rank").alias("ord"), "text")
    most = rows.groupBy(key).agg(F.max("ord").alias("n")).agg(F.max("n")).first()[0] or 0
    while most > 1:
        rows = rows.groupBy(key, F.floor((F.col("ord") - 1) / group).cast("int").alias("g")).agg(ordered_text(F.col("ord"), F.col("text")).alias("text")).select(key, (F.col("g") + 1).alias("ord"), "text")
        rows = combine(rows) if combine else rows
        most = -(-most // group)
    return rows.select(key, "text")


#: fixed values: where texts are cut, strongest first
SEPARATORS = ("\n\n", "\n", ". ", " ")


def cut_places(text: str, between: str, target: int, most: int) -> list[tuple[int, int]]:
    """Start and end of the parts of a text: each ends at the last separator within target, or at the first one after it, and none is longer than most."""
    stops = [m.start() for m in re.finditer(re.escape(between), text)] + [len(text)]
    spans, start = [], 0
    while start < len(text):
        while text.startswith(between, start):
            start += len(between)
        within = bisect_right(stops, start + target) - 1
        end = stops[max(within, bisect_right(stops, start))] if start < len(text) else start
        if end - start > most:
            # no separator in reach: the part is cut where it is full, and what is left begins at its next word
            end = start + most
            follow = len(text) - len(text[end:].lstrip())
        else:
            follow = end + len(between)
        spans.append((start, end))
        start = follow
    return spans


def split_to_fit(text: str, target: int, most: int) -> list[str]:
    """Parts of at most `most` characters, filled up to `target`, cut at the strongest separator that yields more than one part."""
    text = text.strip()
    if len(text) <= most:
        return [text] if text else []
    for between in SEPARATORS:
        if between in text:
            parts = [part for a, b in cut_places(text, between, target, most) if (part := text[a:b].strip())]
            if len(parts) > 1:
                return parts
    return [text[i : i + most].strip() for i in range(0, len(text), most)]


def recursive_parts(texts: DataFrame, target: int = 60_000, most: int = 80_000, key: str = "doc_id") -> DataFrame:
    """key, part (from 1), text: long texts in parts; a greedy fold over each text, so it runs in Python batches."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, p) for k, t in zip(b[key], b["text"], strict=True) for i, p in enumerate(split_to_fit(t or "", target, most), 1)]
            yield pd.DataFrame(rows, columns=[key, "part", "text"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, "text").mapInPandas(run, f"{key} {kind}, part int, text string")


# artifacts -----------------------------------------------------------------------------------


def labelled_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """edge_id, source_label, target_label: labels of both ends, their ids where a node is missing."""
    a = nodes.select(F.col("node_id").alias("source"), F.col("label").alias("_a"))
    b = nodes.select(F.col("node_id").alias("target"), F.col("label").alias("_b"))
    return edges.join(a, "source", "left").join(b, "target", "left").select("edge_id", F.coalesce("_a", F.col("source").cast("string")).alias("source_label"), F.coalesce("_b", F.col("target").cast("string")).alias("target_label"))


def graph_problems(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """problem, id: node ids that repeat, and ends of edges that are no node."""
    again = nodes.groupBy("node_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("repeated node").alias("problem"), F.col("node_id").cast("string").alias("id"))
    ends = edges.select(F.explode(F.array("source", "target")).alias("node_id")).distinct()
    lost = ends.join(nodes.select("node_id"), "node_id", "left_anti").select(F.lit("unknown node").alias("problem"), F.col("node_id").cast("string").alias("id"))
    return again.unionByName(lost)


def best_segment(spans: DataFrame, segs: DataFrame, key: str = "file_id") -> DataFrame:
    """For each span the first segment that contains it, else the first that overlaps it.

    Both sides meet by file; segments of a file are few, and the choice is an aggregate.
    """
    s = segs.select(key, "segment_id", "ord", F.col("char_start").alias("_a"), F.col("char_end").alias("_b"))
    holds = (F.col("_a") <= F.col("char_start")) & (F.col("_b") >= F.col("char_end"))
    met = spans.join(s, key).where((F.col("_a") < F.col("char_end")) & (F.col("_b") > F.col("char_start")))
    best = met.groupBy(*spans.columns).agg(F.min_by("segment_id", F.struct(F.when(holds, 0).otherwise(1), "ord")).alias("segment_id"))
    return best


#: fixed values: what an extractive answer says around its evidence
ANSWER_HEAD = "The locally available evidence most relevant to your question is:\n\n"
ANSWER_TAIL = "\n\nThis answer uses the offline extractive fallback; verify the cited passages for interpretation."
NO_ANSWER = "I could not find grounded text in this scope to answer the question."


def extractive_answer(hits: DataFrame, n: int = 5) -> DataFrame:
    """answer: the first n non-blank snippets as bullets with the names of their files, in order of rank; one row."""
    few = hits.where(strip(F.coalesce("snippet", F.lit(""))) != "").orderBy("rank").limit(n)
    name = F.coalesce(F.expr("nullif(element_at(split(source_relpath, '/'), -1), '')"), F.col("file_id"), F.lit("source"))
    bullets = few.agg(ordered_text(F.col("rank"), F.concat(F.lit("- "), strip(F.col("snippet")), F.lit(" ["), name, F.lit("]")), "\n").alias("b"), F.count(F.lit(1)).alias("n"))
    return bullets.select(F.when(F.col("n") == 0, NO_ANSWER).otherwise(F.concat(F.lit(ANSWER_HEAD), F.col("b"), F.lit(ANSWER_TAIL))).alias("answer"))
