"""Sessions whose site names no folder, and places in large scopes."""

import os
import subprocess
import sys

from pyspark.sql import functions as F

from millrace.operators.ranks import placed


def test_a_session_without_site_settings(tmp_path):
    """The folder of intermediate tables is found where nothing names one."""
    code = """
from millrace.session import local_session, materialize, shared_dir
s = local_session("plain", "2", 2)
assert s.conf.get("spark.checkpoint.dir", None) is None
assert materialize(s.range(5), "x").count() == 5
assert shared_dir(s) == shared_dir(s)
import __spark_entry__ as e
assert e.entry(s).count() == 10
"""
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.getcwd()}
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_places_without_a_task_for_a_scope(spark):
    rows = spark.range(4000).select(F.when(F.col("id") % 3 < 2, "big").otherwise(F.when(F.col("id") % 6 == 2, F.lit(None).cast("string")).otherwise("small")).alias("scope"), F.format_string("%020d", F.col("id") % 1000).alias("a"), F.col("id").alias("b"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        dealt = rows.repartitionByRange("scope", "a", "b").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    # two thirds of the rows are one scope, and no task has half of them
    assert max(r["count"] for r in dealt) < 2000
    got = placed(rows, ["scope"], ["a", "b"]).collect()
    want = {}
    for r in sorted(rows.collect(), key=lambda r: (r.a, r.b)):
        want.setdefault(r.scope, []).append((r.a, r.b))
    assert len(got) == 4000
    assert all(want[r.scope][r["rank"] - 1] == (r.a, r.b) for r in got)
    assert placed(rows.limit(0), ["scope"], ["a", "b"]).count() == 0
