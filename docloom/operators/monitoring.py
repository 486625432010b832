"""Counters of ingest runs and timing summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Upper bounds (seconds) of the processing-time buckets.
TIME_BUCKETS = (1, 2, 5, 10, 30, 60, 120)

# Metric names of a session row.
SESSION_METRICS = (
    "documents_processed_total", "requests_total", "retry_attempts_total", "validation_errors_total", "storage_size_bytes",
)


def status_counts(events: DataFrame, status: str, day: str) -> DataFrame:
    return events.groupBy(status, day).agg(F.count("*").alias("n"))


def time_buckets(events: DataFrame, seconds: str, bounds: Sequence[float] = TIME_BUCKETS, *groups: str) -> DataFrame:
    """Cumulative bucket counts: rows at or below each bound, plus the total and the sum."""
    wide = events.groupBy(*groups).agg(
        F.array(*(F.struct(F.lit(float(b)).alias("le"), F.count_if(F.col(seconds) <= b).alias("n")) for b in bounds)).alias("b"),
        F.count("*").alias("total"),
    )
    return wide.select(*groups, "total", F.explode("b").alias("b")).select(*groups, "b.le", "b.n", "total")


def session_table(samples: DataFrame, combine: str = "sum") -> DataFrame:
    """One row per metric file, sessions with more than one processed document, by time.

    ``combine``: rows of one metric that differ in labels are summed, or the last in label order is taken.
    """
    how = F.sum("sample") if combine == "sum" else F.max_by("sample", "labels")
    per_metric = samples.filter(F.col("metric").isin(*SESSION_METRICS)).groupBy("file", "sampled_at", "metric").agg(how.alias("v"))
    wide = per_metric.groupBy("file", "sampled_at").pivot("metric", list(SESSION_METRICS)).agg(F.first("v"))
    return wide.fillna(0.0, list(SESSION_METRICS)).filter(F.col("documents_processed_total") > 1).orderBy("sampled_at", "file")


def latency_summary(timings: DataFrame, value: str, *groups: str) -> DataFrame:
    """count, mean, population deviation, min, max."""
    return timings.groupBy(*groups).agg(
        F.count("*").alias("runs"), F.round(F.avg(value), 6).alias("avg"), F.round(F.stddev_pop(value), 6).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"),
    )
