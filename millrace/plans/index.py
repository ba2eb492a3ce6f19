"""A written index of chunks that follows edits: parts, and the objects that are out of date in older parts.

Each build or update is one part: chunks with their texts, what is known of them, postings, and vectors. An
update writes a part of the changed objects only, and notes that they are dead in all parts before it; a delete
notes that alone. Statistics are sums: those of parts, less those of what died. A merge writes the live rows of
all parts as one. The list of parts and of dead objects is a snapshot table, so a search sees the index
before or after an update.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.operators.lexical import PACKED, best, scored, shard_of, single, write_part
from millrace.operators.scopes import Scope, in_scope
from millrace.operators.vector import scored_vectors
from millrace.sources.snapshots import FEW, SnapshotTable

#: what names a chunk in postings and about: the place of its part, and its number there
NUMBERS = ("_seq", "_num")
LOG = "what string, id string, seq bigint, n bigint, total double, vectors boolean"


@dataclass(frozen=True)
class Index:
    """An index at a path; its chunks have chunk_id, file_id, source_relpath, text and whatever else they were built with."""

    spark: SparkSession
    path: str
    shards: int = 16
    #: what pinned() has read
    view: tuple[DataFrame, list] | None = field(default=None, compare=False, repr=False)

    def pinned(self) -> Index:
        """The index as it is now: whatever is read from it belongs to one version, whose list is read once."""
        return self if self.view else replace(self, view=self._view())

    def _view(self) -> tuple[DataFrame, list]:
        """The log, and a row for each part and one for all dead objects together."""
        if self.view:
            return self.view
        log = self.log.read()
        part = F.when(F.col("what") == "part", F.col("id"))
        rows = log.groupBy("what", part.alias("id")).agg(F.max("seq").alias("seq"), F.sum("n").alias("n"), F.sum("total").alias("total"), F.first("vectors").alias("vectors"), F.count(F.lit(1)).alias("rows")).collect()
        return log, rows

    @property
    def log(self) -> SnapshotTable:
        return SnapshotTable(self.spark, f"{self.path}/log", ("what", "id"), ("what", "id"), 8)

    # reading -----------------------------------------------------------------------------------

    def parts(self) -> list[tuple[str, int, bool, int]]:
        """Folder, place, whether it has vectors and how many chunks, of each part: a few rows."""
        return sorted(((r["id"], r["seq"], r["vectors"], r["n"]) for r in self._view()[1] if r["what"] == "part"), key=lambda p: p[1])

    def dead(self) -> DataFrame:
        """file_id, before: the parts before this place hold an old version of the file."""
        return self._view()[0].where("what = 'dead'").select(F.col("id").alias("file_id"), F.col("seq").alias("before"))

    def stats(self) -> tuple[int, float | None]:
        """How many live chunks there are, and their mean length in tokens."""
        sign = lambda r: 1 if r["what"] == "part" else -1
        rows = self._view()[1]
        n, total = sum(sign(r) * r["n"] for r in rows), sum(sign(r) * r["total"] for r in rows)
        return (n, total / n) if n else (0, None)

    def _live(self, what: str, only: list[str] | None = None) -> DataFrame | None:
        """The live rows of chunks, about, postings or vectors over all parts."""
        if not self.view:
            return self.pinned()._live(what)
        parts = [p for p in self.parts() if what != "vectors" or p[2]]
        if not parts:
            return None
        # a part without chunks has no folder of texts
        full = [p for p in parts if p[3]]
        if not full and what == "chunks":
            return self._live("about").drop("dl").withColumn("text", F.lit(None).cast("string")).withColumn("shard", F.lit(None).cast("int"))
        parts = full or parts[:1]
        frames = [self.spark.read.parquet(f"{self.path}/parts/{name}/{what}").withColumn("_seq", F.lit(seq)) for name, seq, _, _ in parts]
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
        # lists and vectors name no files: their dead are left out with the chunks that they are joined with
        return self._without_dead(rows) if what not in ("postings", "vectors") and self.has_dead() else rows

    def has_dead(self) -> bool:
        return any(r["what"] == "dead" for r in self._view()[1])

    def _without_dead(self, rows: DataFrame) -> DataFrame:
        d = self.dead().withColumnRenamed("file_id", "_f")
        if sum(r["rows"] for r in self._view()[1] if r["what"] == "dead") <= FEW:
            d = F.broadcast(d)
        return rows.join(d, (F.col("file_id") == F.col("_f")) & (F.col("_seq") < F.col("before")), "left_anti")

    def chunks(self) -> DataFrame:
        """The live chunks with their texts; shard is the folder that a chunk lies in."""
        return self._live("chunks").drop("_num", "_seq")

    def about(self) -> DataFrame:
        """What is known of the live chunks but their texts, and dl, their length in tokens."""
        return self._live("about").drop(*NUMBERS)

    def numbered(self) -> DataFrame:
        """The rows of about with the part and the number that postings name them by."""
        return self._live("about")

    def lists(self) -> DataFrame:
        """Lists of postings (see lexical.write_part) of all parts, with their part; those of dead chunks too."""
        return self._live("postings")

    def postings(self) -> DataFrame:
        """term, _seq, _num, tf, dl of every term in a live chunk."""
        now = self.pinned()
        rows = single(now.lists())
        return rows.join(now.numbered().select(*NUMBERS), list(NUMBERS), "left_semi") if now.has_dead() else rows

    def vectors(self) -> DataFrame | None:
        """What is known of the live chunks that have a vector, and it; None if no part has vectors."""
        now = self.pinned()
        found = now._live("vectors")
        return None if found is None else now.numbered().drop("dl").join(found, list(NUMBERS)).drop(*NUMBERS)

    def near(self, query: list[float], most: int, scope: Scope | None = None, members: DataFrame | None = None) -> DataFrame:
        """What is known of the live chunks (of a scope) that may be among the `most` best by inner product with a vector, and that score."""
        now = self.pinned()
        found = scored_vectors(now._live("vectors"), query)
        among = now._among(scope, members)
        if among is None and now.has_dead():
            among = now.numbered().select(*NUMBERS)
        if among is not None:
            found = found.join(among, list(NUMBERS), "left_semi")
        return best(found, now.numbered(), most, NUMBERS)

    def _among(self, scope: Scope | None, members: DataFrame | None) -> DataFrame | None:
        """The numbers of the live chunks of a scope; None for all."""
        return None if scope is None or scope.kind == "root" else in_scope(self.numbered(), scope, members).select(*NUMBERS)

    def by_ids(self, ids: list[str], files: list | None = None) -> DataFrame:
        """The chunks of a few ids: only the folders of their files are read, and in those the row groups that may have them.

        files are the file_ids of these chunks; where none are given, they are looked up.
        """
        if not ids:
            return self.chunks().drop("shard").limit(0)
        about = self.about()
        if files is None:
            named = about.where(F.col("chunk_id").isin(*ids)).select("file_id")
        else:
            named = self.spark.createDataFrame([(f,) for f in files], StructType([about.schema["file_id"]]))
        shards = [r[0] for r in named.select(shard_of("file_id", self.shards)).distinct().collect()]
        return self.chunks().where(F.col("shard").isin(*shards) & F.col("chunk_id").isin(*ids)).drop("shard")

    def scored(self, query: str, most: int | None = None, scope: Scope | None = None, members: DataFrame | None = None) -> DataFrame:
        """What is known of every live chunk (of a scope) that has a term of the query, and its BM25 score in the whole index.

        most: only those that may be among so many best ones; then what is known of all others isn't shuffled.
        """
        now = self.pinned()
        return scored(now.lists(), now.numbered(), query, *now.stats(), NUMBERS, not now.has_dead(), most=most, among=now._among(scope, members))

    # writing -----------------------------------------------------------------------------------

    def _part(self, chunks: DataFrame, vectors: DataFrame | None) -> tuple[str, int, float]:
        name = uuid.uuid4().hex
        where = f"{self.path}/parts/{name}"
        n, total = write_part(chunks, where, shards=self.shards, near="file_id")
        if vectors is not None:
            self._write_vectors(vectors, where)
        return name, n, total

    def _write_vectors(self, vectors: DataFrame, where: str) -> None:
        """Vectors hold the numbers of their chunks alone, as postings do, so no more than names is shuffled to find them."""
        numbers = self.spark.read.parquet(f"{where}/about").select("chunk_id", "_num")
        vectors.select("chunk_id", "embedding").join(numbers, "chunk_id").select("_num", "embedding").write.options(**PACKED).parquet(f"{where}/vectors")

    def _row(self, what: str, id_: str, seq: int, n: int, total: float, vectors: bool) -> DataFrame:
        return self.spark.createDataFrame([(what, id_, seq, n, total, vectors)], LOG)

    def update(self, changed: DataFrame, chunks: DataFrame | None, vectors: DataFrame | None = None) -> Index:
        """Put the chunks of changed objects in place of those they had.

        changed holds file_id; objects without chunks are deleted. Chunks (and vectors: chunk_id, embedding) are
        those of changed objects only, and nothing else is chunked, tokenized or written. Chunks of other
        objects are an error. Null file_ids name no object. An index that lost all its chunks can be updated again.
        """
        files = changed.select("file_id").where("file_id IS NOT NULL").distinct()
        before = self.log.read()
        seq = before.where("what = 'part'").agg(F.max("seq")).first()[0] + 1
        part = None
        if chunks is not None:
            # written once, then looked at: a part that no list names is nowhere
            part = (*self._part(chunks, vectors), vectors is not None)
            other = self.spark.read.parquet(f"{self.path}/parts/{part[0]}/about").join(files, "file_id", "left_anti").select("file_id").first()
            if other:
                raise ValueError(f"a chunk of {other['file_id']!r}, which isn't among the changed objects")
            part = part if part[1] else None
        # what dies is counted from lengths, which no text is read for; files that no part holds alive need no note
        gone = self.about().join(files, "file_id", "left_semi").groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("total"))
        dead = gone.select(F.lit("dead").alias("what"), F.col("file_id").alias("id"), F.lit(seq).cast("bigint").alias("seq"), "n", "total", F.lit(False).alias("vectors"))
        earlier = before.where("what = 'dead'").select("id", F.col("n").alias("_n"), F.col("total").alias("_t"))
        dead = dead.join(earlier, "id", "left").select("what", "id", "seq", (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"), (F.col("total") + F.coalesce("_t", F.lit(0.0))).alias("total"), "vectors")
        self.log.put(dead if part is None else dead.unionByName(self._row("part", part[0], seq, *part[1:])))
        return self

    def delete(self, files: DataFrame) -> Index:
        """Take objects (file_id) out of the index."""
        return self.update(files, None)

    def merge(self) -> Index:
        """Write the live rows of all parts as one part. Searches return what they did.

        A part that has every row of the index, all of them alive, is that part already and isn't written again.
        """
        now = self.pinned()
        full = [p for p in now.parts() if p[3]]
        old = self.log.read()
        seq = old.where("what = 'part'").agg(F.max("seq")).first()[0] + 1
        n, avgdl = now.stats()
        if len(full) == 1 and not now.has_dead() and (full[0][2] or not any(p[2] for p in now.parts())):
            row = self._row("part", full[0][0], seq, n, n * (avgdl or 0.0), full[0][2])
            self.log.replace(row, old.select("what", "id").unionByName(row.select("what", "id")))
            return self
        name = uuid.uuid4().hex
        where = f"{self.path}/parts/{name}"
        # numbers are those of a part, so postings are made anew from texts, which costs less than dealing them by chunk
        write_part(now.chunks().drop("shard"), where, shards=self.shards, near="file_id")
        vectors = now.vectors()
        if vectors is not None:
            self._write_vectors(vectors, where)
        row = self._row("part", name, seq, n, n * (avgdl or 0.0), vectors is not None)
        self.log.replace(row, old.select("what", "id").unionByName(row.select("what", "id")))
        return self


def build(chunks: DataFrame, path: str, vectors: DataFrame | None = None, shards: int = 16) -> Index:
    """Write the index of chunks (and vectors: chunk_id, embedding) to a new folder; queries read it as often as they like.

    Vectors carry the numbers of their chunks; a search meets what is known of chunks with the few that it may return.
    """
    index = Index(chunks.sparkSession, path, shards)
    name, n, total = index._part(chunks, vectors)
    index.log.put(index._row("part", name, 0, n, total, vectors is not None))
    return index
