"""Reuse of saved results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: saved results are good for a day.
HOURS = 24


def still_to_run(requests: DataFrame, saved: DataFrame, now: Column | None = None, hours: int = HOURS) -> DataFrame:
    """Requests without a saved result of the last ``hours``."""
    now = F.current_timestamp() if now is None else now
    fresh = saved.filter(F.col("saved_at") > now - F.expr(f"INTERVAL {hours} HOURS"))
    return requests.join(fresh.select("request_key"), "request_key", "left_anti")


def reusable(requests: DataFrame, saved: DataFrame, now: Column | None = None, hours: int = HOURS) -> DataFrame:
    """Saved result rows that answer the requests."""
    now = F.current_timestamp() if now is None else now
    fresh = saved.filter(F.col("saved_at") > now - F.expr(f"INTERVAL {hours} HOURS"))
    return fresh.join(requests.select("request_key").distinct(), "request_key", "left_semi")
