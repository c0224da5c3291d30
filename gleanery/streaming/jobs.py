"""Windowed and stateless stream operators on Spark's own state.

Each takes a streaming or a batch DataFrame with an event time ``ts``; on a
batch frame the watermark is ignored and all windows are emitted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.text import mask_map, mask_text
from gleanery.operators.metrics import API_BUCKETS, SLA_SECONDS, bucket_counts, quantile_of_counts

LATENESS = "10 minutes"


def with_event_time(df: DataFrame, ts: str = "ts", lateness: str = LATENESS) -> DataFrame:
    """Event time as TIMESTAMP (NTZ columns carry no watermark) with the watermark set."""
    df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return df.withWatermark(ts, lateness) if df.isStreaming else df


def sliding_sums(df: DataFrame, by: Sequence[str], sums: Mapping[str, Column], width: int, slide: int) -> DataFrame:
    """Sums per sliding window of ``width`` seconds every ``slide``, as ``window`` rows.

    On a batch frame rows are first summed per pane of one slide and only the
    panes are copied into the windows that hold them; a stream keeps one state
    per window instead, which lets it run in every output mode.
    """
    if width % slide:
        raise ValueError("the width must be a multiple of the slide")
    totals = [F.sum(c).alias(n) for n, c in sums.items()]
    timed = with_event_time(df)
    if df.isStreaming:
        return timed.groupBy(F.window("ts", f"{width} seconds", f"{slide} seconds"), *by).agg(*totals)
    pane = F.floor(F.unix_seconds("ts") / F.lit(slide)) * F.lit(slide)
    panes = timed.groupBy(pane.alias("__pane"), *by).agg(*totals)
    starts = F.sequence(F.col("__pane") - F.lit(width - slide), F.col("__pane"), F.lit(slide))
    copied = panes.withColumn("__start", F.explode(starts))
    window = F.struct(F.timestamp_seconds("__start").alias("start"), F.timestamp_seconds(F.col("__start") + width).alias("end"))
    return (
        copied.groupBy("__start", *by).agg(*[F.sum(n).alias(n) for n in sums]).select(window.alias("window"), *by, *sums)
    )


def stream_metrics(df: DataFrame, by: Sequence[str], value: str, failed: Column, width: str = "1 minute") -> DataFrame:
    """Count, mean and failures per tumbling window and key."""
    timed = with_event_time(df)
    return timed.groupBy(F.window("ts", width), *by).agg(
        F.count("*").alias("events"), F.avg(value).alias("mean_value"), F.count_if(failed).alias("errors")
    )


#: Size of the quantile sketches: exact up to as many values, off by about 0.1 % of the ranks beyond.
SKETCH = 4096


def stream_rates(df: DataFrame, by: Sequence[str], seconds: str, failed: Column, size_bytes: Column | None = None, width: int = 300, slide: int = 60) -> DataFrame:
    """Sliding windows of ``width`` seconds: mean and p95 duration, error ratio, bytes per second.

    On a batch frame each row enters one pane of one slide, with its duration in the
    pane's quantile sketch; panes are copied into the windows that hold them and their
    sketches merged. A stream keeps one sketch per window as its state.
    """
    if width % slide:
        raise ValueError("the width must be a multiple of the slide")
    timed = with_event_time(df)
    value = F.col(seconds).cast("double")
    totals = {
        "events": F.count("*"),
        "__n": F.count(value),
        "__sum": F.sum(value),
        "__failed": F.count_if(failed),
        "__bytes": F.sum(size_bytes) if size_bytes is not None else F.lit(None).cast("double"),
        "__sketch": F.kll_sketch_agg_double(value, F.lit(SKETCH)),
    }
    if df.isStreaming:
        counted = timed.groupBy(F.window("ts", f"{width} seconds", f"{slide} seconds"), *by).agg(*[c.alias(n) for n, c in totals.items()])
    else:
        pane = F.floor(F.unix_seconds("ts") / F.lit(slide)) * F.lit(slide)
        panes = timed.groupBy(pane.alias("__pane"), *by).agg(*[c.alias(n) for n, c in totals.items()])
        starts = F.sequence(F.col("__pane") - F.lit(width - slide), F.col("__pane"), F.lit(slide))
        copied = panes.withColumn("__start", F.explode(starts)).groupBy("__start", *by)
        # Panes without a value have an empty sketch, which merges like any other.
        merged = [F.sum(n).alias(n) for n in totals if n != "__sketch"] + [F.kll_merge_agg_double("__sketch", F.lit(SKETCH)).alias("__sketch")]
        window = F.struct(F.timestamp_seconds("__start").alias("start"), F.timestamp_seconds(F.col("__start") + width).alias("end"))
        counted = copied.agg(*merged).withColumn("window", window)
    p95 = F.when(F.col("__n") > 0, F.kll_sketch_get_quantile_double("__sketch", F.lit(0.95)))
    return counted.select(
        "window",
        *by,
        "events",
        F.try_divide("__sum", "__n").alias("mean_seconds"),
        p95.alias("p95_seconds"),
        (F.col("__failed") / F.col("events")).alias("error_ratio"),
        (F.col("__bytes") / F.lit(float(width))).alias("bytes_per_second"),
    )


def window_p95(df: DataFrame, by: Sequence[str], seconds: str, buckets: Sequence[float] = API_BUCKETS, width: int = 300, slide: int = 60) -> DataFrame:
    """The latency rule: 0.95 quantile by bucket counts per sliding window."""
    counts = sliding_sums(df, by, bucket_counts(seconds, buckets), width, slide)
    return counts.select("window", *by, quantile_of_counts(buckets, 0.95).alias("quantile"))


def latest_status(df: DataFrame, key: str = "id", status: str = "status", ts: str = "ts", tie: str = "seq") -> DataFrame:
    """Current status per key; run in update or complete mode on a stream."""
    order = F.struct(F.col(ts).cast("timestamp"), F.col(tie))
    return df.groupBy(key).agg(F.max_by(status, order).alias("status"), F.max(F.col(ts).cast("timestamp")).alias("updated_at"))


def availability(df: DataFrame, by: Sequence[str], up: Column, width: int = 86_400, slide: int = 3600, minimum: float = 0.999) -> DataFrame:
    """Mean of ``up`` (true or false) per sliding window, and whether it alerts."""
    known = F.when(up.isNotNull(), F.lit(1)).otherwise(F.lit(0))
    counts = sliding_sums(df, by, {"__up": F.when(up, F.lit(1)).otherwise(F.lit(0)), "__known": known}, width, slide)
    ratio = F.try_divide("__up", "__known")
    return counts.select("window", *by, ratio.alias("availability"), (ratio < minimum).alias("alert"))


def sla_breaches(executions: DataFrame, seconds: str = "seconds", limit: float = SLA_SECONDS) -> DataFrame:
    """Executions over the limit, or timed out."""
    timed_out = F.coalesce(F.lower("error_message").contains("timed out"), F.lit(False))
    return executions.filter((F.col(seconds) > limit) | timed_out)


def spikes(df: DataFrame, by: Sequence[str], condition: Column, above: int, width: str = "1 minute") -> DataFrame:
    """Windows and keys with more than ``above`` matching events."""
    timed = with_event_time(df.filter(condition))
    return timed.groupBy(F.window("ts", width), *by).agg(F.count("*").alias("events")).filter(F.col("events") > above)


def auth_spikes(df: DataFrame, failed_login: Column, by: Sequence[str] = (), above: int = 100) -> DataFrame:
    """More than ``above`` failed logins a minute."""
    return spikes(df, by, failed_login, above)


def error_spike(df: DataFrame, is_error: Column, by: Sequence[str] = (), above: int = 10) -> DataFrame:
    """More than ``above`` errors a minute."""
    return spikes(df, by, is_error, above)


def mask_log_stream(df: DataFrame, message: str = "message", extra: str | None = None) -> DataFrame:
    """Mask the message and the extra map of each log entry."""
    masked = df.withColumn(message, mask_text(F.col(message)))
    return masked.withColumn(extra, mask_map(F.col(extra))) if extra else masked
