"""Operational metrics: counts, histograms, quantiles, rates, health and trends.

All of them aggregate on the map side; the groups that reach a reducer hold
partial results, never the rows of a hot key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.functions.values import epoch_seconds, url_netloc
from gleanery.plans import grid, slices
from gleanery.plans.joins import null_safe_join

# Histogram bucket bounds in seconds.
API_BUCKETS = (0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)
TASK_BUCKETS = (1.0, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0, 600.0)
STORAGE_BUCKETS = (0.1, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0)

# Responses that are retried.
RETRY_CODES = (500, 502, 503, 504, 408, 429)
MAX_RETRIES = 3

# Alert limits per metric.
ALERT_LIMITS = {
    "latency_ms": (500.0, "api", "High API latency: %.1fms"),
    "cpu_percent": (80.0, "system", "High CPU usage: %.1f%%"),
    "memory_percent": (80.0, "system", "High memory usage: %.1f%%"),
    "error_rate": (0.01, "api", "High error rate: %.4f"),
}
SLA_SECONDS = 300.0


def status_counts(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("type", "status").agg(F.count("*").alias("tasks"))


def error_counts(events: DataFrame, error_type: str = "error_type") -> DataFrame:
    return events.filter(F.col(error_type).isNotNull()).groupBy(error_type).agg(F.count("*").alias("errors"))


def duration_histogram(df: DataFrame, value: str, buckets: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Cumulative buckets ``(by, le, bucket_count, total, sum_value)``; ``le`` ends with infinity.

    One pass of conditional counts; the rows per group are laid out afterwards.
    """
    bounds = [float(b) for b in buckets]
    if bounds != sorted(bounds):
        raise ValueError("bucket bounds must ascend")
    counts = df.groupBy(*by).agg(
        *[F.count_if(F.col(value) <= b).alias(f"__{i}") for i, b in enumerate(bounds)],
        F.count(value).alias("total"),
        F.sum(value).alias("sum_value"),
    )
    rows = [F.struct(F.lit(b).alias("le"), F.col(f"__{i}").alias("bucket_count")) for i, b in enumerate(bounds)]
    rows.append(F.struct(F.lit(float("inf")).alias("le"), F.col("total").alias("bucket_count")))
    return counts.select(*by, F.inline(F.array(*rows)), "total", "sum_value")


def histogram_quantile(buckets: DataFrame, q: float, by: Sequence[str] = (), count: str = "bucket_count") -> DataFrame:
    """Quantile from cumulative buckets by linear interpolation.

    The first bucket starts at 0, a quantile in the infinite bucket gives that
    bucket's lower bound, and a group without samples gives null. Buckets of
    several sources are summed first; the window then holds one row per bound.
    """
    if not 0 <= q <= 1:
        raise ValueError("q must lie in [0, 1]")
    summed = buckets.groupBy(*by, "le").agg(F.sum(count).cast("double").alias("n"))
    bounds = Window.partitionBy(*by).orderBy("le")
    whole = bounds.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = summed.select(
        *by,
        "le",
        "n",
        F.coalesce(F.lag("le").over(bounds), F.lit(0.0)).alias("low"),
        F.coalesce(F.lag("n").over(bounds), F.lit(0.0)).alias("below"),
        (F.last("n").over(whole) * q).alias("rank"),
    )
    inside = F.col("low") + (F.col("le") - F.col("low")) * F.try_divide(F.col("rank") - F.col("below"), F.col("n") - F.col("below"))
    value = F.when(F.col("le") == float("inf"), F.col("low")).otherwise(inside)
    hit = (F.col("n") >= F.col("rank")) & (F.col("rank") > 0)
    return placed.groupBy(*by).agg(F.min_by(F.when(hit, value), F.when(hit, F.col("le"))).alias("quantile"))


def bucket_counts(value: str, buckets: Sequence[float]) -> dict[str, Column]:
    """Indicators to be summed per group: one per bucket bound, and the total."""
    bounds = [float(b) for b in buckets]
    if bounds != sorted(bounds):
        raise ValueError("bucket bounds must ascend")
    one = lambda condition: F.when(condition, F.lit(1)).otherwise(F.lit(0))
    counts = {f"__le_{i}": one(F.col(value) <= b) for i, b in enumerate(bounds)}
    return counts | {"__total": one(F.col(value).isNotNull())}


def quantile_of_counts(buckets: Sequence[float], q: float) -> Column:
    """The quantile of a row holding the sums of :func:`bucket_counts`."""
    if not 0 <= q <= 1:
        raise ValueError("q must lie in [0, 1]")
    rank = F.col("__total") * F.lit(float(q))
    low, below = 0.0, F.lit(0)
    steps = []
    for i, bound in enumerate(map(float, buckets)):
        upto = F.col(f"__le_{i}")
        steps.append((upto >= rank, F.lit(low) + F.lit(bound - low) * F.try_divide(rank - below, upto - below)))
        low, below = bound, upto
    value = F.lit(low)
    for reached, inside in reversed(steps):
        value = F.when(reached, inside).otherwise(value)
    return F.when(rank > 0, value)


def duration_quantile(df: DataFrame, value: str, buckets: Sequence[float], q: float, by: Sequence[str] = ()) -> DataFrame:
    """``histogram_quantile`` of ``duration_histogram`` in one aggregation.

    The bucket counts of a group stay side by side in its row, so nothing is laid
    out per bound, shuffled again or ordered.
    """
    counts = df.groupBy(*by).agg(*[F.sum(c).alias(n) for n, c in bucket_counts(value, buckets).items()])
    return counts.select(*by, quantile_of_counts(buckets, q).alias("quantile"))


def processing_summary(df: DataFrame, by: Sequence[str], status: str, seconds: str, memory: str, quality: str) -> DataFrame:
    """Totals, mean time, peak memory and mean quality; zero where nothing was measured."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return df.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(F.col(status) == "completed").alias("successful"),
        F.count_if(F.col(status) == "failed").alias("failed"),
        mean(seconds).alias("avg_seconds"),
        F.coalesce(F.max(memory), F.lit(0.0)).alias("peak_memory"),
        mean(quality).alias("avg_quality"),
    )


def domain_stats(requests: DataFrame, url: str, status: str, seconds: str) -> DataFrame:
    """Requests, 2xx successes, failures and total time per network location."""
    ok = F.col(status).between(200, 299)
    return requests.groupBy(url_netloc(F.col(url)).alias("domain")).agg(
        F.count("*").alias("requests"),
        F.count_if(ok).alias("success"),
        F.count_if(~F.coalesce(ok, F.lit(False))).alias("failures"),
        F.sum(seconds).alias("total_time"),
    )


def retry_stats(requests: DataFrame, url: str, status: str, retries: str, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Retries made and requests given up, per network location."""
    retryable = F.col(status).isin(*RETRY_CODES)
    return requests.groupBy(url_netloc(F.col(url)).alias("domain")).agg(
        F.count_if(retryable & (F.col(retries) < max_retries)).alias("attempts"),
        F.count_if(retryable & (F.col(retries) >= max_retries)).alias("failures"),
    )


def error_rate(df: DataFrame, by: Sequence[str], status: str = "status") -> DataFrame:
    """failed / (completed + failed); null without finished rows."""
    failed = F.count_if(F.col(status) == "failed")
    done = F.count_if(F.col(status).isin("completed", "failed"))
    return df.groupBy(*by).agg(failed.alias("failed"), done.alias("finished"), F.try_divide(failed, done).alias("error_rate"))


def success_rate_breach(df: DataFrame, by: str, ok: Column, minimum: float = 0.3) -> DataFrame:
    """Processors whose successes / attempts fall below ``minimum``."""
    rate = F.count_if(ok) / F.count("*")
    return df.groupBy(by).agg(F.count("*").alias("attempts"), rate.alias("success_rate")).filter(F.col("success_rate") < minimum)


def percentile_exact(df: DataFrame, value: str, q: float, by: Sequence[str] = (), accuracy: int = 100_000) -> DataFrame:
    """The element at index ``floor(q * n)`` of the sorted values, per group.

    A quantile sketch brackets the answer, one conditional count places the
    bracket exactly, and only values inside it are counted and ordered: about
    ``4 / accuracy`` of a group instead of all of it. Should a bracket miss its
    rank, that group keeps all its values, so the answer is always exact.
    """
    if not 0 <= q <= 1:
        raise ValueError("q must lie in [0, 1]")
    rows = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("__v"))
    margin = 2.0 / accuracy
    bracket = rows.groupBy(*by).agg(
        F.percentile_approx("__v", [max(q - margin, 0.0), min(q + margin, 1.0)], accuracy).alias("__b")
    )
    bracket = bracket.select(*by, F.col("__b")[0].alias("__lo"), F.col("__b")[1].alias("__hi"))
    placed = _with_group(rows, bracket, by)
    ranks = placed.groupBy(*by).agg(
        F.count("*").alias("__n"),
        F.count_if(F.col("__v") < F.col("__lo")).alias("__below"),
        F.count_if(F.col("__v") <= F.col("__hi")).alias("__upto"),
        F.min("__lo").alias("__lo"),
        F.min("__hi").alias("__hi"),
    )
    index = F.least(F.floor(F.lit(float(q)) * F.col("__n")), F.col("__n") - 1)
    caught = (index >= F.col("__below")) & (index < F.col("__upto"))
    target = ranks.select(
        *by,
        F.when(caught, F.col("__lo")).alias("__lo"),
        F.when(caught, F.col("__hi")).alias("__hi"),
        (index - F.when(caught, F.col("__below")).otherwise(F.lit(0))).alias("__index"),
        F.col("__n").alias("samples"),
    )
    candidates = _with_group(rows, target, by).filter(
        F.col("__lo").isNull() | F.col("__v").between(F.col("__lo"), F.col("__hi"))
    )
    counted = candidates.groupBy(*by, "__v").agg(
        F.count("*").alias("__c"), F.min("__index").alias("__index"), F.min("samples").alias("samples")
    )
    # A group's candidates grow with it, and without groups they are all in one.
    summed = slices.running(slices.by_range(counted, by, ["__v"]), by, ["__v"], {"__upto": slices.Running("sum", F.col("__c"))})
    return (
        summed
        .filter(F.col("__upto") > F.col("__index"))
        .groupBy(*by)
        .agg(F.min("__v").alias("percentile"), F.min("samples").alias("samples"))
    )


def _with_group(rows: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """Attach one row of statistics per group. Without groups it is a single row."""
    if by:
        return null_safe_join(rows, stats, by)
    one = rows.withColumn("__stats", stats.select(F.struct("*")).scalar())
    return one.select(*rows.columns, *[F.col(f"__stats.{c}").alias(c) for c in stats.columns])


def throughput(df: DataFrame, seconds: str, by: Sequence[str] = (), size_bytes: str | None = None) -> DataFrame:
    """Pages per minute and, given sizes, MB per second of processing time."""
    total = F.sum(seconds)
    measures = [
        F.count("*").alias("pages"),
        total.alias("seconds"),
        (F.try_divide(F.count("*"), total) * 60).alias("pages_per_minute"),
    ]
    if size_bytes:
        measures.append(F.try_divide(F.sum(size_bytes) / F.lit(1024.0 * 1024.0), total).alias("mb_per_second"))
    return df.groupBy(*by).agg(*measures)


def health_rollup(components: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """ok if all healthy, else degraded if any is degraded, else error. Unknown is unhealthy."""
    healthy = F.bool_and(F.coalesce("healthy", F.lit(False)))
    degraded = F.bool_or(F.coalesce("degraded", F.lit(False)))
    status = F.when(healthy, F.lit("ok")).when(degraded, F.lit("degraded")).otherwise(F.lit("error"))
    return components.groupBy(*by).agg(
        status.alias("status"), healthy.alias("healthy"), degraded.alias("degraded"), F.count("*").alias("components")
    )


def threshold_alerts(metrics: DataFrame, limits: Mapping[str, tuple] = ALERT_LIMITS) -> DataFrame:
    """Rows of ``(.., metric, value)`` over their limit, with component, severity and message.

    Messages are formatted on the JVM, where a half rounds up.
    """
    limit = component = message = F.lit(None)
    for name, (bound, owner, template) in limits.items():
        here = F.col("metric") == name
        limit = F.when(here, F.lit(float(bound))).otherwise(limit)
        component = F.when(here, F.lit(owner)).otherwise(component)
        message = F.when(here, F.format_string(template, F.col("value"))).otherwise(message)
    return metrics.withColumn("limit", limit.cast("double")).filter(F.col("value") > F.col("limit")).withColumns(
        {"severity": F.lit("WARNING"), "component": component, "message": message}
    )


def trend(df: DataFrame, value: str, ts: str, tie: str, by: Sequence[str], window_seconds: float | None = None) -> DataFrame:
    """Current, mean, max, min, samples, and last against first, per resource.

    ``window_seconds`` keeps only samples newer than the resource's last one
    minus that span.
    """
    if window_seconds is not None:
        last = df.groupBy(*by).agg(F.max(ts).alias("__last"))
        # At most one row per resource: a size Spark checks before broadcasting.
        df = null_safe_join(df, last, by).filter(F.unix_micros(F.col("__last").cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp")) < window_seconds * 1e6)
    order = F.struct(ts, tie)
    first, current = F.min_by(value, order), F.max_by(value, order)
    direction = F.when(current > first, F.lit("increasing")).when(current < first, F.lit("decreasing")).otherwise(F.lit("stable"))
    return df.groupBy(*by).agg(
        current.alias("current_value"),
        F.avg(value).alias("average_value"),
        F.max(value).alias("max_value"),
        F.min(value).alias("min_value"),
        F.count(value).alias("samples"),
        direction.alias("trend"),
    )


def crawl_summary(log: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Items scraped and failed requests per crawl; the status follows its retries.

    ``log`` has ``fingerprint, kind ('item' or 'error'), retry_count``. The
    retries per request are :func:`crawl_retries`, one row each.
    """
    items = F.count_if(F.col("kind") == "item")
    failed = F.count_if(F.col("kind") == "error")
    gave_up = F.coalesce(F.max(F.when(F.col("kind") == "error", F.col("retry_count"))), F.lit(0)) >= MAX_RETRIES
    return log.groupBy(*by).agg(
        F.when(gave_up, F.lit("closed")).otherwise(F.lit("completed")).alias("status"),
        items.alias("items_scraped"),
        failed.alias("errors"),
    )


def crawl_retries(log: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Latest retry number per request fingerprint: last seen count plus one."""
    errors = log.filter(F.col("kind") == "error")
    return errors.groupBy(*by, "fingerprint").agg((F.max("retry_count") + 1).alias("retries"))


def execution_history(executions: DataFrame, task: str, order: Sequence[str], value: str) -> DataFrame:
    """Execution ids in order, one row each: ``(task, position, execution_id)`` from 1.

    Long rows have one form for every task, however many executions it has.
    """
    placed = slices.number_rows(slices.by_range(executions, [task], list(order)), [task], list(order), "position")
    return placed.select(task, "position", F.col(value).alias("execution_id"))


def execution_outputs(outputs: DataFrame, execution: str, output: str) -> DataFrame:
    """Distinct outputs per execution, one row each."""
    return outputs.select(execution, output).distinct()


def completion_report(tasks: DataFrame, executions: DataFrame, sla: float = SLA_SECONDS) -> DataFrame:
    """Per task type and day: done, failed, mean and longest time, SLA breaches.

    Executions are reduced per task and day before they meet the tasks.
    """
    finished = F.col("status").isin("completed", "failed")
    per_task = executions.filter(finished).groupBy("task_id", F.date_format("start_time", "yyyy-MM-dd").alias("day")).agg(
        F.count_if(F.col("status") == "completed").alias("done"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.sum("seconds").alias("sum_seconds"),
        F.count("seconds").alias("timed"),
        F.max("seconds").alias("max_seconds"),
        F.count_if(F.col("seconds") > sla).alias("breaches"),
    )
    kinds = tasks.select(F.col("id").alias("task_id"), "type")
    return per_task.join(kinds, "task_id").groupBy("type", "day").agg(
        F.sum("done").alias("done"),
        F.sum("failed").alias("failed"),
        F.try_divide(F.sum("sum_seconds"), F.sum("timed")).alias("avg_seconds"),
        F.max("max_seconds").alias("max_seconds"),
        F.sum("breaches").alias("sla_breaches"),
    )


def system_status(df: DataFrame, by: Sequence[str], failed: Column, seconds: str) -> DataFrame:
    """Health score: 100 less 20 points for each breached limit (errors, latency, SLA)."""
    rate = F.count_if(failed) / F.count("*")
    latency = F.avg(seconds) * 1000
    slow = F.count_if(F.col(seconds) > SLA_SECONDS)
    scored = df.groupBy(*by).agg(
        F.count("*").alias("requests"), rate.alias("error_rate"), latency.alias("avg_latency_ms"), slow.alias("sla_breaches")
    )
    points = lambda cond: F.when(cond, F.lit(20)).otherwise(F.lit(0))
    score = (
        F.lit(100)
        - points(F.col("error_rate") > ALERT_LIMITS["error_rate"][0])
        - points(F.col("avg_latency_ms") > ALERT_LIMITS["latency_ms"][0])
        - points(F.col("sla_breaches") > 0)
    )
    return scored.withColumn("score", score).withColumn(
        "status", F.when(F.col("score") >= 80, F.lit("healthy")).otherwise(F.lit("degraded"))
    )


# --- counters --------------------------------------------------------------


def counter_deltas(samples: DataFrame, series: Sequence[str], ts: str, tie: str, value: str) -> DataFrame:
    """Add ``delta``: growth since the sample before. A drop is a reset, counted from zero."""
    with_prev = slices.running(
        slices.by_range(samples, series, [ts, tie]), series, [ts, tie], {"__prev": slices.Running("prev", F.col(value))}
    )
    grown = F.when(F.col(value) < F.col("__prev"), F.col(value)).otherwise(F.col(value) - F.col("__prev"))
    return with_prev.withColumn("delta", grown).drop("__prev")


def increase(samples: DataFrame, series: Sequence[str], ts: str, tie: str, value: str, seconds: int) -> DataFrame:
    """Counter growth over ``(t - seconds, t]`` at each second with a sample.

    Deltas are summed per second before the window is formed. No extrapolation
    to the window's edges.
    """
    deltas = counter_deltas(samples, series, ts, tie, value)
    per_second = deltas.groupBy(*series, epoch_seconds(F.col(ts)).alias("second")).agg(F.sum("delta").alias("d"))
    grown = slices.trailing(per_second, series, "second", seconds, {"increase": ("sum", F.col("d"))})
    return grown.withColumn("increase", F.coalesce("increase", F.lit(0.0)))


def rate(samples: DataFrame, series: Sequence[str], ts: str, tie: str, value: str, seconds: int) -> DataFrame:
    """Per-second rate of a counter over the window; see :func:`increase`."""
    grown = increase(samples, series, ts, tie, value, seconds)
    return grown.withColumn("rate", F.col("increase") / F.lit(float(seconds))).drop("increase")


def changes(samples: DataFrame, series: Sequence[str], ts: str, tie: str, value: str, seconds: int) -> DataFrame:
    """Number of value changes over ``(t - seconds, t]`` at each second with a sample."""
    with_prev = slices.running(
        slices.by_range(samples, series, [ts, tie]), series, [ts, tie], {"__prev": slices.Running("prev", F.struct(F.col(value).alias("v")))}
    )
    changed = F.col("__prev").isNotNull() & ~F.col("__prev.v").eqNullSafe(F.col(value))
    per_second = with_prev.groupBy(*series, epoch_seconds(F.col(ts)).alias("second")).agg(F.count_if(changed).alias("c"))
    return slices.trailing(per_second, series, "second", seconds, {"changes": ("sum", F.col("c"))})


def grid_rate(samples: DataFrame, series: Sequence[str], ts: str, tie: str, value: str, seconds: int = grid.LOOKBACK, step: int = grid.STEP) -> DataFrame:
    """Per-second rate of a counter at every tick with a sample in ``(tick - seconds, tick]``."""
    deltas = counter_deltas(samples, series, ts, tie, value)
    grown = grid.trailing_sums(deltas, series, ts, {"__grown": F.col("delta")}, seconds, step)
    return grown.select(*series, "tick", (F.coalesce("__grown", F.lit(0.0)) / F.lit(float(seconds))).alias("rate"))


def request_rates(samples: DataFrame, by: Sequence[str], series: Sequence[str], ts: str, tie: str, value: str, seconds: int = grid.LOOKBACK, step: int = grid.STEP) -> DataFrame:
    """Sum of the series' rates by ``by`` at each tick, whenever each was sampled.

    A sum of trailing sums is the trailing sum of the sums, and ``by`` has a row at a tick
    as soon as one of its series has. So deltas are added up over the series first, and
    rows are repeated for ``by`` alone.
    """
    if not set(by) <= set(series):
        raise ValueError(f"{list(by)} must be among the columns of the series {list(series)}")
    deltas = counter_deltas(samples, series, ts, tie, value)
    grown = grid.trailing_sums(deltas, by, ts, {"__grown": F.col("delta")}, seconds, step)
    return grown.select(*by, "tick", (F.coalesce("__grown", F.lit(0.0)) / F.lit(float(seconds))).alias("rate"))


def utilization(cpu: DataFrame, memory: DataFrame, seconds: int = grid.LOOKBACK, step: int = grid.STEP) -> tuple[DataFrame, DataFrame]:
    """(cpu, memory) utilisation ratios per instance and tick.

    ``cpu(instance, core, mode, ts, tie, value)`` holds cumulated seconds; the cores of an
    instance may be sampled at different moments. ``memory(instance, ts, tie, available,
    total)`` holds bytes, of which the last sample counts.
    """
    idle = grid_rate(cpu.filter(F.col("mode") == "idle"), ["instance", "core"], "ts", "tie", "value", seconds, step)
    busy = idle.groupBy("instance", "tick").agg((F.lit(1.0) - F.avg("rate")).alias("cpu_utilization"))
    held = grid.last_values(memory, ["instance"], "ts", ["tie"], ["available", "total"], step)
    used = held.select("instance", "tick", (F.lit(1.0) - F.try_divide("available", "total")).alias("memory_utilization"))
    return busy, used


def drop_metrics(series: DataFrame, name: str = "metric", pattern: str = "go_.*") -> DataFrame:
    """Drop series whose whole name matches."""
    return series.filter(~F.col(name).rlike(f"^(?:{pattern})$"))
