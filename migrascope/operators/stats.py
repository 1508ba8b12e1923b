"""Counters over analysed files and change events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths, status


def scan_stats(analyzed: DataFrame) -> DataFrame:
    """One row: total (errors included), files per status, errors."""
    fine = F.col("error_kind").isNull()
    of = lambda s: F.count_if(fine & (F.col("status") == s)).alias(s)
    return analyzed.agg(F.count("*").alias("total"), of("legacy"), of("migrated"), of("partial"), of("no_models"), F.count_if(~fine).alias("errors"))


def with_rates(stats: DataFrame) -> DataFrame:
    """``stats`` with needs_migration, with_models, progress_percent and success_rate."""
    c = F.col
    return stats.withColumns(
        {
            "needs_migration": c("legacy") + c("partial"),
            "with_models": c("legacy") + c("migrated") + c("partial"),
            "progress_percent": status.progress_percent(c("legacy"), c("migrated"), c("partial")),
            "success_rate": status.success_rate(c("total"), c("errors")),
        }
    )


def batch_stats(events: DataFrame) -> DataFrame:
    """One row over change events: total, typescript, unique paths."""
    return events.agg(F.count("*").alias("total"), F.count_if(paths.is_typescript(F.col("path"))).alias("typescript"), F.count_distinct("path").alias("unique_files"))


def unique_paths(events: DataFrame) -> DataFrame:
    return events.select("path").distinct().orderBy("path")


def typescript_events(events: DataFrame) -> DataFrame:
    return events.where(paths.is_typescript(F.col("path")))
