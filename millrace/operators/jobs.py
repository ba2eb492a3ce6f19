"""Runs and queued jobs as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def next_job(jobs: DataFrame) -> DataFrame:
    """The oldest queued job: id, created_at. One row, or none."""
    return jobs.where("status = 'queued'").orderBy("created_at", "id").limit(1)


def latest_runs(runs: DataFrame, limit: int = 10) -> DataFrame:
    return runs.orderBy(F.desc("created_at"), F.desc("id")).limit(max(1, min(500, limit)))


def status_counts(runs: DataFrame) -> DataFrame:
    return runs.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
