"""Per-key sequences: attempts, transitions, runs, sliding counts, batches.

Nothing here gathers a key's rows in one task: keys are cut into slices
(:mod:`gleanery.plans.slices`) or pre-aggregated to whole seconds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.values import backoff_seconds, epoch_seconds
from gleanery.operators.catalog import may_move
from gleanery.plans import slices


def attempts(df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str]) -> DataFrame:
    """1-based ``attempt`` per key in time order."""
    return slices.number_rows(slices.by_range(df, keys, [ts, *tie]), keys, [ts, *tie], "attempt")


def backoff(df: DataFrame, attempt: str = "attempt", base: float = 5.0) -> DataFrame:
    """Waits before the next try: doubling from ``base``, capped at 60, and growing by half."""
    n = F.col(attempt) - 1
    return df.withColumns(
        {
            "delay": backoff_seconds(n, base, 2.0),
            "capped_delay": backoff_seconds(n, 1.0, 2.0, 60.0),
            "slow_delay": backoff_seconds(n, 1.0, 1.5),
        }
    )


def illegal_transitions(history: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str], status: str = "status") -> DataFrame:
    """Rows whose status may not follow the one before; an unchanged status is no move."""
    moved = slices.running(
        slices.by_range(history, keys, [ts, *tie]), keys, [ts, *tie], {"previous": slices.Running("prev", F.col(status))}
    )
    changed = F.col("previous").isNotNull() & (F.col("previous") != F.col(status))
    return moved.filter(changed & ~may_move(F.col("previous"), F.col(status)))


def running_mean(df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str], value: str) -> DataFrame:
    """Mean and peak of all values up to each row."""
    out = slices.running(
        slices.by_range(df, keys, [ts, *tie]),
        keys,
        [ts, *tie],
        {
            "__sum": slices.Running("sum", F.col(value)),
            "__n": slices.Running("sum", F.when(F.col(value).isNotNull(), F.lit(1)).otherwise(F.lit(0))),
            "running_peak": slices.Running("max", F.col(value)),
        },
    )
    return out.withColumn("running_mean", F.try_divide("__sum", "__n")).drop("__sum", "__n")


def requests_in_window(requests: DataFrame, client: str, ts: str, seconds: int, limit: int) -> DataFrame:
    """Requests in ``(t - seconds, t]`` per client, at each second with a request.

    ``remaining = max(0, limit - requests)``; ``reset_seconds`` until the oldest
    request leaves. All requests count; admission is ``streaming.stateful.rate_limit``.
    """
    per_second = requests.groupBy(client, epoch_seconds(F.col(ts)).alias("second")).agg(F.count("*").alias("n"))
    counted = slices.trailing(
        per_second, [client], "second", seconds, {"requests": ("sum", F.col("n")), "__oldest": ("min", F.col("second"))}
    )
    return counted.select(
        client,
        "second",
        "requests",
        F.greatest(F.lit(0).cast("long"), F.lit(limit) - F.col("requests")).alias("remaining"),
        (F.col("__oldest") + F.lit(seconds) - F.col("second")).alias("reset_seconds"),
    )


def failure_runs(df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str], failed: Column, n: int = 5) -> DataFrame:
    """Runs of at least ``n`` failures with no success between: start, end, length."""
    bad = F.coalesce(failed, F.lit(False))
    numbered = slices.running(
        slices.by_range(df.withColumn("__bad", bad), keys, [ts, *tie]),
        keys,
        [ts, *tie],
        {"run": slices.Running("sum", F.when(F.col("__bad"), F.lit(0)).otherwise(F.lit(1)))},
    )
    runs = numbered.filter("__bad").groupBy(*keys, "run").agg(
        F.min(ts).alias("run_start"), F.max(ts).alias("run_end"), F.count("*").alias("failures")
    )
    return runs.filter(F.col("failures") >= n).drop("run")


def batch_rows(df: DataFrame, order: Sequence[str], size: int = 100) -> DataFrame:
    """Consecutive chunks of ``size`` rows in a total order; the last may be short."""
    if size <= 0:
        raise ValueError("batch size must be a positive integer")
    numbered = slices.number_all(df, order, "__no")
    return numbered.withColumn("batch", F.floor((F.col("__no") - 1) / F.lit(size))).drop("__no")
