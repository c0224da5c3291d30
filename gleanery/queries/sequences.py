"""Per-key sequences and alert grouping (F, H7)."""

from datetime import datetime

from pyspark.sql import functions as F

from gleanery.operators import alerts, windows
from gleanery.queries import query
from gleanery.queries.views import EXECUTIONS, TASKS, executions, sql_time, table, tasks, time_text


@query(
    "f01_attempts",
    f"WITH {EXECUTIONS} SELECT id, task_id, row_number() OVER (PARTITION BY task_id ORDER BY start_time, id) AS attempt FROM executions",
)
def attempts(spark, sf):
    e = executions(spark, sf).select("id", "task_id", "start_time")
    return windows.attempts(e, ["task_id"], "start_time", ["id"]).drop("start_time")


@query(
    "f01_backoff",
    f"""WITH {EXECUTIONS}, a AS (SELECT id, row_number() OVER (PARTITION BY task_id ORDER BY start_time, id) - 1 AS n FROM executions)
        SELECT id, 5.0 * pow(2, n) AS delay, least(pow(2, n), 60.0) AS capped_delay, round(pow(1.5, n), 6) AS slow_delay FROM a""",
)
def backoff(spark, sf):
    e = executions(spark, sf).select("id", "task_id", "start_time")
    tried = windows.attempts(e, ["task_id"], "start_time", ["id"])
    return windows.backoff(tried).select("id", "delay", "capped_delay", F.round("slow_delay", 6).alias("slow_delay"))


def _history(spark, sf):
    """Events as status changes of one task per user."""
    status = (
        F.when(F.col("event_type") == "signup", F.lit("pending"))
        .when(F.col("event_type") == "view", F.lit("running"))
        .when(F.col("event_type") == "purchase", F.lit("completed"))
        .when(F.col("event_type") == "error", F.lit("failed"))
        .otherwise(F.lit("cancelled"))
    )
    return table(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), status.alias("status"))


_HISTORY = """history AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running'
     WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'cancelled' END AS status FROM events)"""


@query(
    "f02_illegal_transitions",
    f"""WITH {_HISTORY}, m AS (SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM history)
        SELECT event_id, user_id, previous, status FROM m WHERE previous <> status AND (previous, status) NOT IN
          (('pending', 'running'), ('pending', 'cancelled'), ('running', 'completed'), ('running', 'failed'), ('failed', 'pending'), ('cancelled', 'pending'))""",
)
def illegal_transitions(spark, sf):
    found = windows.illegal_transitions(_history(spark, sf), ["user_id"], "ts", ["event_id"])
    return found.select("event_id", "user_id", "previous", "status")


@query(
    "f04_running_mean",
    """SELECT event_id, round(avg(value) OVER w, 9) AS running_mean, max(value) OVER w AS running_peak FROM events
       WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
)
def running_mean(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    out = windows.running_mean(e, ["user_id"], "ts", ["event_id"], "value")
    return out.select("event_id", F.round("running_mean", 9).alias("running_mean"), "running_peak")


@query(
    "f06_requests_in_window",
    """WITH s AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS second, count(*) AS n FROM events GROUP BY ALL),
            c AS (SELECT user_id, second, CAST(sum(n) OVER w AS BIGINT) AS requests, min(second) OVER w AS oldest FROM s
                  WINDOW w AS (PARTITION BY user_id ORDER BY second RANGE BETWEEN 43199 PRECEDING AND CURRENT ROW))
       SELECT user_id, second, requests, greatest(0, 5 - requests) AS remaining, oldest + 43200 - second AS reset_seconds FROM c""",
)
def requests_in_window(spark, sf):
    return windows.requests_in_window(table(spark, sf, "events"), "user_id", "ts", 43_200, 5)


@query(
    "f07_failure_runs",
    f"""WITH r AS (SELECT user_id, ts, value < 60 AS bad, sum(CAST(NOT value < 60 AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events)
        SELECT user_id, {sql_time('min(ts)')} AS run_start, {sql_time('max(ts)')} AS run_end, count(*) AS failures
        FROM r WHERE bad GROUP BY user_id, run HAVING count(*) >= 5""",
)
def failure_runs(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    runs = windows.failure_runs(e, ["user_id"], "ts", ["event_id"], F.col("value") < 60)
    return runs.select("user_id", time_text("run_start").alias("run_start"), time_text("run_end").alias("run_end"), "failures")


@query(
    "f09_batch_rows",
    f"WITH {TASKS} SELECT id, (row_number() OVER (ORDER BY tasks.created_at, id) - 1) // 100 AS batch FROM tasks",
)
def batch_rows(spark, sf):
    return windows.batch_rows(tasks(spark, sf).select("created_at", "id"), ["created_at", "id"]).select("id", "batch")


def _alerts(spark, sf):
    """Events as alerts, graded by cost; a member is one user in one group."""
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_type").alias("alertname"),
        F.lit(None).cast("string").alias("cluster"),
        F.concat(F.lit("day"), F.date_format("ts", "dd")).alias("service"),
        F.when(F.col("value") > 150, F.lit("critical")).when(F.col("value") > 60, F.lit("warning")).otherwise(F.lit("info")).alias("severity"),
        F.col("user_id").cast("string").alias("fingerprint"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


_ALERTS = """alerts AS (SELECT event_type AS alertname, 'day' || strftime(ts, '%d') AS service,
      CASE WHEN value > 150 THEN 'critical' WHEN value > 60 THEN 'warning' ELSE 'info' END AS severity, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS second
      FROM events)"""


@query(
    "h07_route_alerts",
    f"""WITH {_ALERTS} SELECT severity, CASE severity WHEN 'critical' THEN 'pagerduty-critical' WHEN 'warning' THEN 'email-warnings' ELSE 'default-receiver' END AS receiver,
          CAST(CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 60 ELSE 30 END AS INTEGER) AS group_wait,
          CAST(CASE severity WHEN 'critical' THEN 3600 WHEN 'warning' THEN 21600 ELSE 14400 END AS INTEGER) AS repeat_interval,
          alertname || '_' || service AS dedup_key, count(*) AS n FROM alerts GROUP BY ALL""",
)
def route_alerts(spark, sf):
    keys = ["severity", "receiver", "group_wait", "repeat_interval", "dedup_key"]
    return alerts.route_alerts(_alerts(spark, sf)).groupBy(*keys).agg(F.count("*").alias("n"))


@query(
    "h07_group_alerts",
    f"""WITH {_ALERTS}, a AS (SELECT DISTINCT alertname, service, severity, user_id, second FROM alerts),
        i AS (SELECT *, CASE WHEN second - lag(second) OVER (PARTITION BY alertname, service, severity, user_id ORDER BY second) < 300 THEN 0 ELSE 1 END AS first FROM a),
        j AS (SELECT *, sum(first) OVER (PARTITION BY alertname, service, severity, user_id ORDER BY second) AS span FROM i),
        m AS (SELECT alertname, service, severity, user_id, span, min(second) AS joined, max(second) + 300 AS ended FROM j GROUP BY ALL),
        o AS (SELECT *, CASE WHEN joined < max(ended) OVER (PARTITION BY alertname, service, severity ORDER BY joined, user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                THEN 0 ELSE 1 END AS begins FROM m),
        l AS (SELECT *, sum(begins) OVER (PARTITION BY alertname, service, severity ORDER BY joined, user_id ROWS UNBOUNDED PRECEDING) AS life FROM o),
        g AS (SELECT *, min(joined) OVER w + CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 60 ELSE 30 END AS flush_0, max(ended) OVER w AS over_at,
                CASE severity WHEN 'critical' THEN 12 WHEN 'warning' THEN 72 ELSE 48 END AS step FROM l WINDOW w AS (PARTITION BY alertname, service, severity, life)),
        t AS (SELECT alertname, service, severity, life, flush_0, over_at, step, CAST(greatest(0, ceil((joined - flush_0) / 300.0)) AS BIGINT) AS tick, count(*) AS n FROM g GROUP BY ALL),
        s AS (SELECT *, CAST(floor((least(epoch(TIMESTAMP '2024-01-31'), over_at - 1) - flush_0) / 300.0) AS BIGINT) AS last_tick,
                lead(tick) OVER w AS next_tick, CAST(sum(n) OVER w AS BIGINT) AS members FROM t
              WINDOW w AS (PARTITION BY alertname, service, severity, life ORDER BY tick)),
        r AS (SELECT *, unnest(range(tick, least(coalesce(next_tick, last_tick + 1), last_tick + 1), step)) AS due FROM s WHERE tick <= last_tick),
        n AS (SELECT alertname, service, severity, flush_0 + due * 300 AS notify_at, members, CASE WHEN due = tick THEN n ELSE 0 END AS new_members,
                CASE WHEN due = tick THEN 'new' ELSE 'repeat' END AS reason FROM r
              UNION ALL
              SELECT alertname, service, severity, over_at, CAST(sum(n) AS BIGINT), 0, 'resolved' FROM t
              WHERE over_at <= epoch(TIMESTAMP '2024-01-31') AND over_at > flush_0 GROUP BY alertname, service, severity, life, over_at)
        SELECT *, CASE severity WHEN 'critical' THEN 'pagerduty-critical' WHEN 'warning' THEN 'email-warnings' ELSE 'default-receiver' END AS receiver FROM n""",
)
def group_alerts(spark, sf):
    sent = alerts.group_alerts(_alerts(spark, sf), datetime(2024, 1, 31))
    return sent.select("alertname", "service", "severity", "notify_at", "members", "new_members", "reason", "receiver")
