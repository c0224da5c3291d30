"""Recording and alerting rules, evaluated on a common grid of ticks.

A recording rule gives ``(labels, tick, value)``; an alerting rule compares the value
with its limit at every tick and fires once the comparison has held for its time.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.operators import alerts, metrics
from gleanery.plans import grid


@dataclass(frozen=True)
class AlertRule:
    """Fires where the value stays above (or below) ``limit`` for ``minutes``."""

    name: str
    limit: float
    minutes: float
    severity: str
    above: bool = True

    def holds(self, value: Column) -> Column:
        return F.coalesce(value > self.limit if self.above else value < self.limit, F.lit(False))


# The alerting rules.
HIGH_LATENCY = AlertRule("APIHighLatency", 0.5, 5, "warning")
TASK_DELAY = AlertRule("TaskProcessingDelay", 300.0, 10, "warning")
LOW_THROUGHPUT = AlertRule("StorageLowThroughput", 52_428_800.0, 5, "warning", above=False)
UNAVAILABLE = AlertRule("ServiceUnavailable", 0.999, 5, "critical", above=False)
HIGH_ERROR_RATE = AlertRule("HighErrorRate", 0.01, 5, "critical")
HIGH_CPU = AlertRule("HighCPUUsage", 0.8, 15, "warning")
HIGH_MEMORY = AlertRule("HighMemoryUsage", 0.8, 15, "warning")
# Windows of the recording rules, in seconds.
WINDOW = 300
DAY = 86_400


def latency_p95(requests: DataFrame, by: Sequence[str], ts: str, seconds: str, step: int = grid.STEP) -> DataFrame:
    """0.95 quantile of durations, from bucket counts over the last five minutes."""
    sums = metrics.bucket_counts(seconds, metrics.API_BUCKETS)
    counts = grid.trailing_sums(requests, by, ts, sums, WINDOW, step)
    return counts.select(*by, "tick", metrics.quantile_of_counts(metrics.API_BUCKETS, 0.95).alias("value"))


def _ratio(df: DataFrame, by: Sequence[str], ts: str, part: Column, whole: Column, window: int, step: int) -> DataFrame:
    sums = grid.trailing_sums(df, by, ts, {"__part": part, "__whole": whole}, window, step)
    return sums.select(*by, "tick", F.try_divide("__part", "__whole").alias("value"))


def mean_duration(tasks: DataFrame, by: Sequence[str], ts: str, seconds: str, step: int = grid.STEP) -> DataFrame:
    """Mean seconds of the tasks that ended in the last five minutes."""
    known = F.when(F.col(seconds).isNotNull(), F.lit(1))
    return _ratio(tasks, by, ts, F.col(seconds), known, WINDOW, step)


def byte_rate(transfers: DataFrame, by: Sequence[str], ts: str, size: str, step: int = grid.STEP) -> DataFrame:
    """Bytes a second over the last five minutes."""
    sums = grid.trailing_sums(transfers, by, ts, {"__bytes": F.col(size)}, WINDOW, step)
    return sums.select(*by, "tick", (F.col("__bytes") / F.lit(float(WINDOW))).alias("value"))


def error_ratio(requests: DataFrame, by: Sequence[str], ts: str, failed: Column, step: int = grid.STEP) -> DataFrame:
    """Failed among all requests of the last five minutes."""
    return _ratio(requests, by, ts, F.when(failed, F.lit(1)).otherwise(F.lit(0)), F.lit(1), WINDOW, step)


def availability(checks: DataFrame, by: Sequence[str], ts: str, up: Column, step: int = grid.STEP) -> DataFrame:
    """Share of the checks of the last day that found the service up."""
    return _ratio(checks, by, ts, F.when(up, F.lit(1)).when(~up, F.lit(0)), F.when(up.isNotNull(), F.lit(1)), DAY, step)


def firing(values: DataFrame, by: Sequence[str], rule: AlertRule, step: int = grid.STEP) -> DataFrame:
    """Alerts ``(alertname, cluster, service, severity, tick, active_since)`` at each tick they fire.

    ``service`` joins the labels. A tick at which a label has no value ends its run.
    """
    if not by:
        raise ValueError("an alert needs a label")
    seen = values.select(*by, "tick", rule.holds(F.col("value")).alias("active"))
    states = alerts.alerts_for(seen, by, rule.minutes, step)
    return states.filter(F.col("state") == "firing").select(
        F.lit(rule.name).alias("alertname"),
        F.lit(None).cast("string").alias("cluster"),
        F.concat_ws("/", *by).alias("service"),
        F.lit(rule.severity).alias("severity"),
        "tick",
        "active_since",
    )
