"""The alerting rules at their own limits, windows and times (F8).

Events stand in for the requests, tasks, transfers and checks of two jobs.
"""

from pyspark.sql import functions as F

from gleanery.operators import metrics, monitoring
from gleanery.plans import journeys
from gleanery.queries import query
from gleanery.queries.metrics import MEMORY_SQL, _CPU, asof_rate_sql, grid_sql, node_samples
from gleanery.queries.views import table

_LOG = """log AS (SELECT CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'api' ELSE 'worker' END AS job, ts, value,
     value / 100 AS seconds, value * 10 AS task_seconds, value * 100000000 AS bytes, event_type = 'error' AS failed FROM events)"""


def _log(spark, sf):
    v, kind = F.col("value"), F.col("event_type")
    return table(spark, sf, "events").select(
        F.when(kind.isin("click", "view", "purchase"), F.lit("api")).otherwise(F.lit("worker")).alias("job"),
        "ts", (v / 100).alias("seconds"), (v * 10).alias("task_seconds"), (v * 100_000_000).alias("bytes"), (kind == "error").alias("failed"),
    )


def _firing_sql(rule: monitoring.AlertRule, values: str, by: str = "job") -> str:
    """SQL twin of ``monitoring.firing`` over ``values(by, tick, value)``."""
    sign = ">" if rule.above else "<"
    return f"""ev AS (SELECT {by}, tick, coalesce(value {sign} {rule.limit}, false) AS active FROM ({values})),
         st AS (SELECT *, tick - 15 * row_number() OVER (PARTITION BY {by}, active ORDER BY tick) AS run FROM ev),
         sn AS (SELECT *, min(tick) OVER (PARTITION BY {by}, active, run) AS since FROM st)
       SELECT '{rule.name}' AS alertname, CAST(NULL AS VARCHAR) AS cluster, CAST({by} AS VARCHAR) AS service, '{rule.severity}' AS severity,
              tick, since AS active_since FROM sn WHERE active AND tick - since >= {int(rule.minutes * 60)}"""


_LE = [f"le_{i}" for i in range(len(metrics.API_BUCKETS))]
_BUCKETS = {n: f"CASE WHEN seconds <= {b} THEN 1 ELSE 0 END" for n, b in zip(_LE, metrics.API_BUCKETS)} | {"total": "1"}


def _p95_sql() -> str:
    """The quantile from the bucket counts of a row."""
    cases, low, below = [], 0.0, "0"
    for name, bound in zip(_LE, metrics.API_BUCKETS):
        inside = f"{low} + ({bound} - {low}) * (0.95 * total - {below}) / nullif({name} - {below}, 0)"
        cases.append(f"WHEN {name} >= 0.95 * total THEN {inside}")
        low, below = bound, name
    return f"SELECT job, tick, CASE {' '.join(cases)} ELSE {low} END AS value FROM g"


_LATENCY_SQL = f"WITH {_LOG}, {grid_sql('job', _BUCKETS, 'log')}, {_firing_sql(monitoring.HIGH_LATENCY, _p95_sql())}"


@query(
    "f08_latency_alerts",
    f"SELECT service, tick, active_since, 'email-warnings' AS receiver, 'APIHighLatency_' || service AS dedup_key FROM ({_LATENCY_SQL})",
)
def latency_alerts(spark, sf):
    fired = journeys.latency_alerts(_log(spark, sf), ["job"], "seconds")
    return fired.select("service", "tick", "active_since", "receiver", "dedup_key")


_MEAN = {"part": "task_seconds", "whole": "1"}


@query(
    "f08_task_delay",
    f"WITH {_LOG}, {grid_sql('job', _MEAN, 'log')}, {_firing_sql(monitoring.TASK_DELAY, 'SELECT job, tick, part / whole AS value FROM g')}",
)
def task_delay(spark, sf):
    return monitoring.firing(monitoring.mean_duration(_log(spark, sf), ["job"], "ts", "task_seconds"), ["job"], monitoring.TASK_DELAY)


@query(
    "f08_low_throughput",
    f"WITH {_LOG}, {grid_sql('job', {'part': 'bytes'}, 'log')}, {_firing_sql(monitoring.LOW_THROUGHPUT, 'SELECT job, tick, part / 300.0 AS value FROM g')}",
)
def low_throughput(spark, sf):
    return monitoring.firing(monitoring.byte_rate(_log(spark, sf), ["job"], "ts", "bytes"), ["job"], monitoring.LOW_THROUGHPUT)


_BAD = {"part": "CASE WHEN failed THEN 1 ELSE 0 END", "whole": "1"}


@query(
    "f08_high_error_rate",
    f"WITH {_LOG}, {grid_sql('job', _BAD, 'log')}, {_firing_sql(monitoring.HIGH_ERROR_RATE, 'SELECT job, tick, part / whole AS value FROM g')}",
)
def high_error_rate(spark, sf):
    return monitoring.firing(monitoring.error_ratio(_log(spark, sf), ["job"], "ts", F.col("failed")), ["job"], monitoring.HIGH_ERROR_RATE)


_UP = {"part": "CASE WHEN failed THEN 0 ELSE 1 END", "whole": "1"}


@query(
    "f08_unavailable",
    f"WITH {_LOG}, {grid_sql('job', _UP, 'log', 86_400)}, {_firing_sql(monitoring.UNAVAILABLE, 'SELECT job, tick, part / whole AS value FROM g')}",
)
def unavailable(spark, sf):
    return monitoring.firing(monitoring.availability(_log(spark, sf), ["job"], "ts", ~F.col("failed")), ["job"], monitoring.UNAVAILABLE)


_IDLE = "SELECT instance, tick, 1 - avg(grown / 300) AS value FROM r GROUP BY ALL"


@query("f08_high_cpu", f"WITH {asof_rate_sql('instance, core', _CPU)}, {_firing_sql(monitoring.HIGH_CPU, _IDLE, 'instance')}")
def high_cpu(spark, sf):
    busy = metrics.utilization(*node_samples(spark, sf))[0].withColumnRenamed("cpu_utilization", "value")
    return monitoring.firing(busy, ["instance"], monitoring.HIGH_CPU)


@query("f08_high_memory", f"WITH {MEMORY_SQL}, {_firing_sql(monitoring.HIGH_MEMORY, 'SELECT instance, tick, value FROM used', 'instance')}")
def high_memory(spark, sf):
    used = metrics.utilization(*node_samples(spark, sf))[1].withColumnRenamed("memory_utilization", "value")
    return monitoring.firing(used, ["instance"], monitoring.HIGH_MEMORY)
