"""Tables that are changed scope by scope and read as of one commit.

A table is a folder of Parquet files and a list of them for each version:

    data/<commit>/bucket=<n>/...    what one commit wrote, never changed afterwards
    versions/version=<n>/...        where each bucket of that version lies: one file, which appears at once

A commit writes the buckets that it touches to a new folder and then the list. Readers take the newest list,
so they see the table before the commit or after it, never in between; a commit that fails half way
leaves files that no list names. Buckets are by hash of the scope, so a change of some scopes reads and
writes only theirs and all others stay as they were written.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: ids that are sent to tasks, so that the texts they pick needn't be shuffled to meet them
FEW = 100_000
LISTED = "bucket int, folder string, commit string, schema string, op string, at timestamp"


class CommitConflict(RuntimeError):
    """Another commit made this version first; read again and repeat the change."""


@dataclass(frozen=True)
class SnapshotTable:
    """A table at a path. scope: the columns that change together; name: those that name a row, scope included."""

    spark: SparkSession
    path: str
    scope: tuple[str, ...] = ("scope_type", "scope_id")
    name: tuple[str, ...] = ("scope_type", "scope_id", "kind", "method")
    buckets: int = 16

    def __post_init__(self):
        if not set(self.scope) <= set(self.name):
            raise ValueError("the columns of the scope must be among those of the name")

    # reading ---------------------------------------------------------------------------------

    def history(self) -> DataFrame:
        """version, commit, op, at, buckets: the versions that can be read; an empty table has none."""
        return self._listed().groupBy("version", "commit", "op", "at").agg(F.count("folder").alias("buckets"))

    def version(self) -> int:
        """The newest version; 0 before the first commit."""
        return self._listed().agg(F.max("version")).first()[0] or 0

    def read(self, version: int | None = None, only: Column | None = None, scopes: DataFrame | None = None) -> DataFrame:
        """The rows of a version (the newest). scopes: only the buckets of these scopes are read, and only their rows returned.

        A table without a commit is an AnalysisException, as a path without files is; an unknown version is a ValueError.
        """
        rows = self._rows(version, None if scopes is None else self._touched(scopes))
        if scopes is not None:
            rows = _semi(rows, scopes, self.scope, "left_semi")
        return rows if only is None else rows.where(only)

    def _found(self) -> DataFrame:
        """What all commits have listed; empty before the first."""
        try:
            return self.spark.read.schema(f"{LISTED}, version bigint").parquet(f"{self.path}/versions")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e.getCondition() or e):
                raise
            return self.spark.createDataFrame([], f"{LISTED}, version bigint")

    def _listed(self) -> DataFrame:
        found = self._found()
        # of two commits that made the same version, the one with the least name holds
        first = found.groupBy("version").agg(F.min("commit").alias("_c"))
        return found.join(F.broadcast(first), "version").where("commit = _c").drop("_c")

    def _list(self, version: int | None) -> tuple[int, dict[int, str], StructType | None]:
        """At most a row for each bucket comes to the driver."""
        found = self._found()
        newest = found.agg(F.max("version")).first()[0] or 0 if version is None else version
        rows = found.where(F.col("version") == newest).collect()
        if version is not None and not rows:
            raise ValueError(f"{self.path} has no version {version}")
        version, holds = newest, min((r["commit"] for r in rows), default=None)
        rows = [r for r in rows if r["commit"] == holds]
        schema = StructType.fromJson(json.loads(rows[0]["schema"])) if rows else None
        return version, {r["bucket"]: r["folder"] for r in rows if r["folder"]}, schema

    def _rows(self, version: int | None, buckets: set[int] | None) -> DataFrame:
        found, folders, schema = self._list(version)
        if schema is None:
            raise AnalysisException(f"nothing was committed to {self.path}")
        paths = [f"{self.path}/{f}/bucket={b}" for b, f in sorted(folders.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # writing ---------------------------------------------------------------------------------

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.scope), F.lit(self.buckets)).cast("int")

    def _touched(self, rows: DataFrame) -> set[int]:
        return {r[0] for r in rows.select(self.bucket()).distinct().collect()}

    def put(self, rows: DataFrame, order: str | None = None) -> int:
        """Write rows; those of the same name are replaced, all others stay. Returns the new version.

        Several rows of one name in a call are settled by the greatest `order`; without it they are an error.
        Columns that the table doesn't know yet are added, null in the rows that were there.
        """
        if order:
            # names come from the groups, so that where only they are asked for, what the rows hold isn't made
            rest = [c for c in rows.columns if c not in self.name]
            latest = rows.groupBy(*self.name).agg(F.max_by(F.struct(*rest), F.struct(order, F.xxhash64(*rows.columns))).alias("_r"))
            rows = latest.select(*[F.col(c if c in self.name else f"_r.{c}") for c in rows.columns])
        elif not rows.groupBy(*self.name).count().where("count > 1").isEmpty():
            raise ValueError("several rows have one name")
        return self._change("put", rows, rows, lambda before: _semi(before, rows, self.name, "left_anti"))

    def replace(self, rows: DataFrame, scopes: DataFrame | None = None) -> int:
        """Write rows in place of all that their scopes (or the given ones) hold; scopes without rows end empty."""
        of = rows.select(*self.scope) if scopes is None else scopes.select(*self.scope)
        return self._change("replace", rows, of, lambda before: _semi(before, of, self.scope, "left_anti"))

    def delete(self, gone: DataFrame) -> int:
        """Take out the rows of the scopes in gone, or, if gone has all columns of the name, the rows of these names."""
        by = self.name if set(self.name) <= set(gone.columns) else self.scope
        return self._change("delete", None, gone, lambda before: _semi(before, gone, by, "left_anti"))

    def update(self, rows: DataFrame) -> int:
        """Set the columns of rows in the table's rows of the same name; other columns, and other rows, stay. Unknown names are left out."""
        new = [c for c in rows.columns if c not in self.name]

        def changed(before: DataFrame) -> DataFrame:
            for c in new:
                if c not in before.columns:
                    before = before.withColumn(c, F.lit(None).cast(rows.schema[c].dataType))
            given = rows.select(F.struct(*self.name).alias("_name"), F.struct(*new).alias("_new"))
            met = before.alias("b").join(given, _same(self.name), "left")
            return met.select(*[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"b.{c}")).alias(c) if c in new else F.col(f"b.{c}") for c in before.columns])

        if not rows.groupBy(*self.name).count().where("count > 1").isEmpty():
            raise ValueError("several rows have one name")
        return self._change("update", None, rows, changed)

    def _change(self, op: str, new: DataFrame | None, touching: DataFrame, keep) -> int:
        """Rewrite the buckets that `touching` touches: what `keep` leaves of them, and the new rows."""
        base, folders, schema = self._list(None)
        touched = self._touched(touching)
        before = None if schema is None else keep(self._rows(base, touched) if base else None)
        parts = [x for x in (before, new) if x is not None]
        if not parts:
            raise ValueError(f"nothing was committed to {self.path}")
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
        commit = uuid.uuid4().hex
        folder = f"data/{commit}"
        # buckets are written by several tasks if they are large, and by one if they are small
        dealt = rows.withColumn("bucket", self.bucket()).hint("rebalance", "bucket")
        dealt.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/{folder}")
        kept = self.spark.read.parquet(f"{self.path}/{folder}").select("bucket").distinct().collect() if self._has_files(folder) else []
        full = {r["bucket"] for r in kept}
        now = {b: f for b, f in folders.items() if b not in touched} | dict.fromkeys(full, folder)
        self._publish(base + 1, now, commit, rows.schema, op)
        return base + 1

    def _has_files(self, folder: str) -> bool:
        """Whether a commit wrote any row: an empty one leaves a folder that Spark can't read as a table."""
        try:
            return "bucket" in self.spark.read.parquet(f"{self.path}/{folder}").columns
        except AnalysisException:
            return False

    def _publish(self, version: int, folders: dict[int, str], commit: str, schema: StructType, op: str) -> None:
        kind = schema.json()
        rows = [(b, f, commit, kind, op) for b, f in sorted(folders.items())] or [(None, None, commit, kind, op)]
        listed = self.spark.createDataFrame(rows, "bucket int, folder string, commit string, schema string, op string").withColumn("at", F.current_timestamp())
        try:
            # one file: its name appears when the job commits
            listed.coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/versions/version={version}")
        except AnalysisException as e:
            raise CommitConflict(f"version {version} of {self.path} is there already") from e
        holds = self._listed().where(F.col("version") == version).select("commit").first()[0]
        if holds != commit:
            raise CommitConflict(f"version {version} of {self.path} was made by another commit")

    def unused(self, keep: int = 1) -> DataFrame:
        """folder: what only versions before the last `keep` name; whoever runs the store may delete these folders."""
        listed = self._listed().where("folder IS NOT NULL")
        top = self.version()
        used = listed.where(F.col("version") > top - keep).select("folder").distinct()
        return listed.select("folder").distinct().join(used, "folder", "left_anti")


def _same(columns: tuple[str, ...]) -> Column:
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"b.{c}").eqNullSafe(F.col(f"_name.{c}"))
    return same


def _semi(rows: DataFrame, keys: DataFrame, by: tuple[str, ...], how: str) -> DataFrame:
    """A semi or anti join in which nulls are equal."""
    named = keys.select(F.struct(*by).alias("_name")).distinct()
    if named.limit(FEW + 1).count() <= FEW:
        named = F.broadcast(named)
    return rows.alias("b").join(named, _same(by), how)
