"""Operational metrics and counter queries (E, F10, F11)."""

from pyspark.sql import functions as F

from gleanery.functions.values import duration_text
from gleanery.operators import alerts, metrics
from gleanery.queries import query
from gleanery.queries.views import EXECUTIONS, REQUESTS, TASKS, executions, requests, table, tasks


def rounded(df, *columns, digits: int = 6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("e01_status_counts", f"WITH {TASKS} SELECT type, status, count(*) AS tasks FROM tasks GROUP BY ALL")
def status_counts(spark, sf):
    return metrics.status_counts(tasks(spark, sf))


@query("e02_error_counts", "SELECT props AS error_type, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY ALL")
def error_counts(spark, sf):
    kind = F.when(F.col("event_type") == "error", F.col("props")).alias("error_type")
    return metrics.error_counts(table(spark, sf, "events").select(kind))


def _histogram_sql(source, value, buckets, by):
    bounds = ", ".join(f"{float(b)}::DOUBLE" for b in buckets)
    return f"""SELECT {by}, b.le, count(*) FILTER (WHERE s.{value} <= b.le) AS bucket_count, count(s.{value}) AS total, sum(s.{value}) AS sum_value
        FROM {source} s, (SELECT unnest([{bounds}, 'inf'::DOUBLE]) AS le) b GROUP BY ALL"""


@query(
    "e03_duration_histogram",
    f"WITH {REQUESTS}, h AS ({_histogram_sql('requests', 'seconds', metrics.API_BUCKETS, 'endpoint')}) SELECT endpoint, CAST(le AS VARCHAR) AS le, bucket_count, total, round(sum_value, 4) AS sum_value FROM h",
)
def duration_histogram(spark, sf):
    h = metrics.duration_histogram(requests(spark, sf), "seconds", metrics.API_BUCKETS, ["endpoint"])
    le = F.when(F.col("le") == float("inf"), F.lit("inf")).otherwise(F.col("le").cast("string"))
    return rounded(h.withColumn("le", le), "sum_value", digits=4)


@query(
    "e03_task_histogram",
    f"WITH {EXECUTIONS}, h AS ({_histogram_sql('executions', 'seconds', metrics.TASK_BUCKETS, 'status')}) SELECT status, CAST(le AS VARCHAR) AS le, bucket_count, total, CAST(sum_value AS BIGINT) AS sum_value FROM h",
)
def task_histogram(spark, sf):
    h = metrics.duration_histogram(executions(spark, sf), "seconds", metrics.TASK_BUCKETS, ["status"])
    return h.withColumn("le", F.when(F.col("le") == float("inf"), F.lit("inf")).otherwise(F.col("le").cast("string")))


@query(
    "e04_processing_summary",
    f"""WITH {EXECUTIONS} SELECT worker_id, count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS successful,
          count(*) FILTER (WHERE status = 'failed') AS failed, round(coalesce(avg(seconds), 0), 6) AS avg_seconds,
          round(coalesce(max(memory), 0), 6) AS peak_memory, round(coalesce(avg(quality), 0), 6) AS avg_quality
        FROM executions GROUP BY worker_id""",
)
def processing_summary(spark, sf):
    s = metrics.processing_summary(executions(spark, sf), ["worker_id"], "status", "seconds", "memory", "quality")
    return rounded(s, "avg_seconds", "peak_memory", "avg_quality")


_CODES = "CASE event_type WHEN 'error' THEN CASE WHEN value > 50 THEN 503 ELSE 404 END WHEN 'signup' THEN 429 ELSE 200 END"


def _http(spark, sf):
    """Events as HTTP responses of one of a hundred hosts."""
    status = (
        F.when(F.col("event_type") == "error", F.when(F.col("value") > 50, F.lit(503)).otherwise(F.lit(404)))
        .when(F.col("event_type") == "signup", F.lit(429))
        .otherwise(F.lit(200))
    )
    url = F.concat(F.lit("https://host"), (F.col("user_id") % 100).cast("string"), F.lit(".example.com:8443/p/"), F.col("event_id").cast("string"))
    return table(spark, sf, "events").select(
        "event_id", url.alias("url"), status.alias("status"), (F.col("value") / 100).alias("seconds"), F.floor(F.col("value") / 20).alias("retries")
    )


_HTTP = f"http AS (SELECT 'host' || (user_id % 100) || '.example.com:8443' AS domain, {_CODES} AS status, value / 100 AS seconds, CAST(floor(value / 20) AS BIGINT) AS retries FROM events)"


@query(
    "e05_domain_stats",
    f"""WITH {_HTTP} SELECT domain, count(*) AS requests, count(*) FILTER (WHERE status BETWEEN 200 AND 299) AS success,
          count(*) FILTER (WHERE status NOT BETWEEN 200 AND 299) AS failures, round(sum(seconds), 4) AS total_time FROM http GROUP BY domain""",
)
def domain_stats(spark, sf):
    return rounded(metrics.domain_stats(_http(spark, sf), "url", "status", "seconds"), "total_time", digits=4)


@query(
    "e06_retry_stats",
    f"""WITH {_HTTP} SELECT domain, count(*) FILTER (WHERE status IN (500, 502, 503, 504, 408, 429) AND retries < 3) AS attempts,
          count(*) FILTER (WHERE status IN (500, 502, 503, 504, 408, 429) AND retries >= 3) AS failures FROM http GROUP BY domain""",
)
def retry_stats(spark, sf):
    return metrics.retry_stats(_http(spark, sf), "url", "status", "retries")


@query(
    "e07_error_rate",
    f"""WITH {EXECUTIONS}, c AS (SELECT worker_id, count(*) FILTER (WHERE status = 'failed') AS failed,
          count(*) FILTER (WHERE status IN ('completed', 'failed')) AS finished FROM executions GROUP BY worker_id)
        SELECT worker_id, failed, finished, round(failed / nullif(finished, 0), 6) AS error_rate FROM c""",
)
def error_rate(spark, sf):
    return rounded(metrics.error_rate(executions(spark, sf), ["worker_id"]), "error_rate")


@query(
    "e08_success_rate_breach",
    """SELECT user_id, count(*) AS attempts, round(count(*) FILTER (WHERE value > 70) / count(*), 6) AS success_rate
       FROM events GROUP BY user_id HAVING count(*) FILTER (WHERE value > 70) / count(*) < 0.3""",
)
def success_rate_breach(spark, sf):
    return rounded(metrics.success_rate_breach(table(spark, sf, "events"), "user_id", F.col("value") > 70), "success_rate")


_NEAREST = """SELECT {by} list_extract(list_sort(list({v})), CAST(least(floor({q} * count({v})), count({v}) - 1) AS BIGINT) + 1) AS percentile,
       count({v}) AS samples FROM {t} {group}"""


@query("e09_percentile_exact", _NEAREST.format(by="event_type,", v="value", q=0.95, t="events", group="GROUP BY event_type"))
def percentile_exact(spark, sf):
    return metrics.percentile_exact(table(spark, sf, "events"), "value", 0.95, ["event_type"])


@query("e09_percentile_exact_all", _NEAREST.format(by="", v="l_extendedprice", q=0.5, t="lineitem", group=""))
def percentile_exact_all(spark, sf):
    return metrics.percentile_exact(table(spark, sf, "lineitem"), "l_extendedprice", 0.5)


def _quantile_sql(cte: str, by: str, q: float) -> str:
    """SQL twin of histogram_quantile over ``h(by, le, bucket_count)``."""
    return f"""{cte}, p AS (SELECT {by}, le, bucket_count AS n, coalesce(lag(le) OVER w, 0) AS low, coalesce(lag(bucket_count) OVER w, 0) AS below,
             max(bucket_count) OVER (PARTITION BY {by}) * {q} AS rank FROM h WINDOW w AS (PARTITION BY {by} ORDER BY le)),
           hit AS (SELECT * FROM p WHERE n >= rank AND rank > 0 QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY le) = 1)
           SELECT {by}, round(CASE WHEN le = 'inf'::DOUBLE THEN low ELSE low + (le - low) * (rank - below) / nullif(n - below, 0) END, 6) AS quantile
           FROM (SELECT DISTINCT {by} FROM h) LEFT JOIN hit USING ({by})"""


@query(
    "e10_histogram_quantile",
    _quantile_sql(f"WITH {REQUESTS}, h AS ({_histogram_sql('requests', 'seconds', metrics.API_BUCKETS, 'endpoint')})", "endpoint", 0.95),
)
def histogram_quantile(spark, sf):
    h = metrics.duration_histogram(requests(spark, sf), "seconds", metrics.API_BUCKETS, ["endpoint"])
    return rounded(metrics.histogram_quantile(h, 0.95, ["endpoint"]), "quantile")


@query(
    "e10_histogram_quantile_top_bucket",
    _quantile_sql(f"WITH {REQUESTS}, h AS ({_histogram_sql('requests', 'seconds', (0.1, 0.25), 'client')})", "client", 0.9),
)
def histogram_quantile_top(spark, sf):
    h = metrics.duration_histogram(requests(spark, sf), "seconds", (0.1, 0.25), ["client"])
    return rounded(metrics.histogram_quantile(h, 0.9, ["client"]), "quantile")


@query(
    "e10_duration_quantile",
    _quantile_sql(f"WITH {REQUESTS}, h AS ({_histogram_sql('requests', 'seconds', metrics.API_BUCKETS, 'client')})", "client", 0.5),
)
def duration_quantile(spark, sf):
    return rounded(metrics.duration_quantile(requests(spark, sf), "seconds", metrics.API_BUCKETS, 0.5, ["client"]), "quantile")


@query(
    "e11_throughput",
    """WITH p AS (SELECT lang, length(text) / 1000.0 AS seconds, octet_length(encode(text)) AS bytes FROM documents)
       SELECT lang, count(*) AS pages, round(sum(seconds), 4) AS seconds, round(count(*) / sum(seconds) * 60, 6) AS pages_per_minute,
              round(sum(bytes) / 1048576.0 / sum(seconds), 6) AS mb_per_second FROM p GROUP BY lang""",
)
def throughput(spark, sf):
    docs = table(spark, sf, "documents").select("lang", (F.length("text") / 1000.0).alias("seconds"), F.octet_length("text").alias("bytes"))
    out = metrics.throughput(docs, "seconds", ["lang"], "bytes")
    return rounded(rounded(out, "seconds", digits=4), "pages_per_minute", "mb_per_second")


@query(
    "e12_health_rollup",
    """WITH c AS (SELECT o_custkey AS system, o_orderstatus <> 'F' OR o_totalprice > 100000 AS healthy, o_orderpriority = '1-URGENT' AS degraded FROM orders),
            r AS (SELECT system, bool_and(healthy) AS healthy, bool_or(degraded) AS degraded, count(*) AS components FROM c GROUP BY system)
       SELECT *, CASE WHEN healthy THEN 'ok' WHEN degraded THEN 'degraded' ELSE 'error' END AS status FROM r""",
)
def health_rollup(spark, sf):
    c = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("system"),
        ((F.col("o_orderstatus") != "F") | (F.col("o_totalprice") > 100000)).alias("healthy"),
        (F.col("o_orderpriority") == "1-URGENT").alias("degraded"),
    )
    return metrics.health_rollup(c, ["system"])


@query(
    "e13_threshold_alerts",
    """WITH m AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'latency_ms' WHEN 'view' THEN 'cpu_percent' WHEN 'click' THEN 'memory_percent' ELSE 'disk' END AS metric,
              CASE WHEN event_type = 'error' THEN value * 10 ELSE value END + 0.001 AS value FROM events)
       SELECT event_id, metric, "limit", 'WARNING' AS severity, CASE metric WHEN 'latency_ms' THEN 'api' ELSE 'system' END AS component,
              CASE metric WHEN 'latency_ms' THEN printf('High API latency: %.1fms', value) WHEN 'cpu_percent' THEN printf('High CPU usage: %.1f%%', value)
                   ELSE printf('High memory usage: %.1f%%', value) END AS message
       FROM (SELECT *, CASE metric WHEN 'latency_ms' THEN 500.0::DOUBLE WHEN 'disk' THEN NULL ELSE 80.0::DOUBLE END AS "limit" FROM m) WHERE value > "limit" """,
)
def threshold_alerts(spark, sf):
    kind = F.col("event_type")
    metric = F.when(kind == "error", F.lit("latency_ms")).when(kind == "view", F.lit("cpu_percent")).when(kind == "click", F.lit("memory_percent")).otherwise(F.lit("disk"))
    # The shift keeps values off the halves, which formatters round either way.
    value = F.when(kind == "error", F.col("value") * 10).otherwise(F.col("value")) + 0.001
    m = table(spark, sf, "events").select("event_id", metric.alias("metric"), value.alias("value"))
    return metrics.threshold_alerts(m).drop("value")


@query(
    "e14_trend",
    """WITH s AS (SELECT * FROM events QUALIFY epoch_us(max(ts) OVER (PARTITION BY user_id)) - epoch_us(ts) < 864000 * 1000000::BIGINT)
       SELECT user_id, arg_max(value, (ts, event_id)) AS current_value, round(avg(value), 6) AS average_value, max(value) AS max_value, min(value) AS min_value,
              count(*) AS samples, CASE WHEN arg_max(value, (ts, event_id)) > arg_min(value, (ts, event_id)) THEN 'increasing'
                WHEN arg_max(value, (ts, event_id)) < arg_min(value, (ts, event_id)) THEN 'decreasing' ELSE 'stable' END AS trend
       FROM s GROUP BY user_id""",
)
def trend(spark, sf):
    return rounded(metrics.trend(table(spark, sf, "events"), "value", "ts", "event_id", ["user_id"], 864_000), "average_value")


_CRAWL = "log AS (SELECT user_id AS crawl, sha256(props) AS fingerprint, CASE event_type WHEN 'error' THEN 'error' ELSE 'item' END AS kind, CAST(floor(value / 100) AS BIGINT) AS retry_count FROM events)"


def _crawl(spark, sf):
    return table(spark, sf, "events").select(
        F.col("user_id").alias("crawl"),
        F.sha2("props", 256).alias("fingerprint"),
        F.when(F.col("event_type") == "error", F.lit("error")).otherwise(F.lit("item")).alias("kind"),
        F.floor(F.col("value") / 100).alias("retry_count"),
    )


@query(
    "e15_crawl_summary",
    f"""WITH {_CRAWL} SELECT crawl, CASE WHEN coalesce(max(retry_count) FILTER (WHERE kind = 'error'), 0) >= 3 THEN 'closed' ELSE 'completed' END AS status,
          count(*) FILTER (WHERE kind = 'item') AS items_scraped, count(*) FILTER (WHERE kind = 'error') AS errors FROM log GROUP BY crawl""",
)
def crawl_summary(spark, sf):
    return metrics.crawl_summary(_crawl(spark, sf), ["crawl"])


@query("e15_crawl_retries", f"WITH {_CRAWL} SELECT crawl, fingerprint, max(retry_count) + 1 AS retries FROM log WHERE kind = 'error' GROUP BY ALL")
def crawl_retries(spark, sf):
    return metrics.crawl_retries(_crawl(spark, sf), ["crawl"])


@query(
    "e16_execution_history",
    f"""WITH {EXECUTIONS}, n AS (SELECT task_id, id, row_number() OVER (PARTITION BY task_id ORDER BY start_time, id) AS position FROM executions)
        SELECT task_id, position, id AS execution_id FROM n""",
)
def execution_history(spark, sf):
    e = executions(spark, sf).select("task_id", "id", "start_time")
    return metrics.execution_history(e, "task_id", ["start_time", "id"], "id")


@query("e16_execution_outputs", "SELECT DISTINCT l_orderkey AS execution, l_partkey AS output FROM lineitem")
def execution_outputs(spark, sf):
    o = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("execution"), F.col("l_partkey").alias("output"))
    return metrics.execution_outputs(o, "execution", "output")


_PART = "CASE WHEN {e} > 0 THEN {e} || '{u}' END"
_DURATION = "coalesce(nullif(concat_ws(' ', " + ", ".join(_PART.format(e=e, u=u) for e, u in (("s // 86400", "d"), ("s // 3600 % 24", "h"), ("s // 60 % 60", "m"), ("s % 60", "s"))) + "), ''), '0s')"


@query("e16_duration_text", f"WITH {EXECUTIONS} SELECT task_id, {_DURATION} AS took FROM (SELECT task_id, CAST(sum(seconds) * 60 AS BIGINT) AS s FROM executions GROUP BY task_id)")
def duration_text_of_tasks(spark, sf):
    total = executions(spark, sf).groupBy("task_id").agg((F.sum("seconds") * 60).alias("s"))
    return total.select("task_id", duration_text(F.col("s")).alias("took"))


@query(
    "e17_completion_report",
    f"""WITH {TASKS}, {EXECUTIONS} SELECT t.type, strftime(start_time, '%Y-%m-%d') AS day, count(*) FILTER (WHERE e.status = 'completed') AS done,
          count(*) FILTER (WHERE e.status = 'failed') AS failed, round(avg(seconds), 6) AS avg_seconds, max(seconds) AS max_seconds,
          count(*) FILTER (WHERE seconds > 300) AS sla_breaches
        FROM executions e JOIN tasks t ON t.id = e.task_id WHERE e.status IN ('completed', 'failed') GROUP BY ALL""",
)
def completion_report(spark, sf):
    return rounded(metrics.completion_report(tasks(spark, sf), executions(spark, sf)), "avg_seconds")


@query(
    "e18_system_status",
    f"""WITH {REQUESTS}, s AS (SELECT client, count(*) AS requests, count(*) FILTER (WHERE failed) / count(*) AS error_rate,
          avg(seconds) * 1000 AS avg_latency_ms, count(*) FILTER (WHERE seconds > 300) AS sla_breaches FROM requests GROUP BY client),
        p AS (SELECT *, 100 - CASE WHEN error_rate > 0.01 THEN 20 ELSE 0 END - CASE WHEN avg_latency_ms > 500 THEN 20 ELSE 0 END
              - CASE WHEN sla_breaches > 0 THEN 20 ELSE 0 END AS score FROM s)
        SELECT client, requests, round(error_rate, 6) AS error_rate, round(avg_latency_ms, 6) AS avg_latency_ms, sla_breaches, CAST(score AS INTEGER) AS score,
               CASE WHEN score >= 80 THEN 'healthy' ELSE 'degraded' END AS status FROM p""",
)
def system_status(spark, sf):
    return rounded(metrics.system_status(requests(spark, sf), ["client"], F.col("failed"), "seconds"), "error_rate", "avg_latency_ms")


def _rate_sql(series: str, value: str, window: int, source: str = "events", extra: str = "") -> str:
    """SQL twin of increase/rate: deltas with resets, summed per second, then over the window."""
    return f"""d AS (SELECT {series}, CAST(floor(epoch(ts)) AS BIGINT) AS second,
              CASE WHEN {value} < lag({value}) OVER w THEN {value} ELSE {value} - lag({value}) OVER w END AS delta
              FROM {source} {extra} WINDOW w AS (PARTITION BY {series} ORDER BY ts, event_id)),
            per_second AS (SELECT {series}, second, sum(delta) AS d FROM d GROUP BY ALL),
            grown AS (SELECT {series}, second, coalesce(sum(d) OVER (PARTITION BY {series} ORDER BY second RANGE BETWEEN {window - 1} PRECEDING AND CURRENT ROW), 0) AS grown FROM per_second)"""


@query("f11_increase", f"WITH {_rate_sql('user_id', 'value', 3600)} SELECT user_id, second, round(grown, 4) AS increase FROM grown")
def increase(spark, sf):
    e = table(spark, sf, "events")
    return rounded(metrics.increase(e, ["user_id"], "ts", "event_id", "value", 3600), "increase", digits=4)


@query("f11_rate", f"WITH {_rate_sql('user_id', 'value', 10000)} SELECT user_id, second, round(grown / 10000, 6) AS rate FROM grown")
def rate(spark, sf):
    return rounded(metrics.rate(table(spark, sf, "events"), ["user_id"], "ts", "event_id", "value", 10_000), "rate")


def grid_sql(by: str, sums: dict[str, str], source: str, seconds: int = 300) -> str:
    """SQL twin of ``grid.trailing_sums``: CTEs ``slots`` (all ticks) and ``g`` (the sums)."""
    per_tick = ", ".join(f"sum({e}) AS {n}" for n, e in sums.items())
    over = ", ".join(f"sum({n}) OVER w AS {n}" for n in sums)
    return f"""b AS (SELECT {by}, CAST(ceil(epoch_us(ts) / 15000000.0) * 15 AS BIGINT) AS tick, {per_tick} FROM {source} GROUP BY ALL),
         spans AS (SELECT {by}, tick, least(coalesce(lead(tick) OVER (PARTITION BY {by} ORDER BY tick), tick + {seconds}), tick + {seconds}) AS until FROM b),
         slots AS (SELECT {by}, unnest(range(tick, until, 15)) AS tick FROM spans),
         g AS (SELECT {by}, tick, {over} FROM slots LEFT JOIN b USING ({by}, tick)
               WINDOW w AS (PARTITION BY {by} ORDER BY tick RANGE BETWEEN {seconds - 15} PRECEDING AND CURRENT ROW))"""


def asof_rate_sql(series: str, source: str) -> str:
    """Rates on the grid by looking up the counter's growth as of each tick and five minutes before."""
    same = lambda t: " AND ".join(f"{t}.{c.strip()} = s.{c.strip()}" for c in series.split(","))
    return f"""d AS (SELECT {series}, ts, event_id, CASE WHEN value < lag(value) OVER w THEN value ELSE value - lag(value) OVER w END AS delta
              FROM {source} WINDOW w AS (PARTITION BY {series} ORDER BY ts, event_id)),
            c AS (SELECT {series}, ts, max(total) AS total FROM (
                    SELECT {series}, ts, coalesce(sum(delta) OVER (PARTITION BY {series} ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) AS total FROM d) GROUP BY ALL),
            {grid_sql(series, {"n": "1"}, source)},
            s AS (SELECT *, make_timestamp(tick * 1000000) AS now, make_timestamp((tick - 300) * 1000000) AS back FROM slots),
            r AS (SELECT s.*, a.total - coalesce(z.total, 0) AS grown FROM s ASOF JOIN c a ON {same("a")} AND s.now >= a.ts ASOF LEFT JOIN c z ON {same("z")} AND s.back >= z.ts)"""


@query(
    "e20_request_rates",
    f"WITH {asof_rate_sql('event_type, user_id', 'events')} SELECT event_type, tick, round(sum(grown) / 300, 4) AS rate FROM r GROUP BY ALL",
)
def request_rates(spark, sf):
    e = table(spark, sf, "events")
    return rounded(metrics.request_rates(e, ["event_type"], ["event_type", "user_id"], "ts", "event_id", "value"), "rate", digits=4)


@query(
    "f11_grid_rate",
    f"WITH {asof_rate_sql('user_id', 'events')} SELECT user_id, tick, round(grown / 300, 4) AS rate FROM r",
)
def grid_rate(spark, sf):
    return rounded(metrics.grid_rate(table(spark, sf, "events"), ["user_id"], "ts", "event_id", "value"), "rate", digits=4)


@query(
    "f10_changes",
    """WITH c AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS second,
               CAST(lag(event_id) OVER w IS NOT NULL AND event_type <> lag(event_type) OVER w AS INTEGER) AS changed
               FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
            s AS (SELECT user_id, second, sum(changed) AS c FROM c GROUP BY ALL)
       SELECT user_id, second, CAST(sum(c) OVER (PARTITION BY user_id ORDER BY second RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS BIGINT) AS changes FROM s""",
)
def changes(spark, sf):
    return metrics.changes(table(spark, sf, "events"), ["user_id"], "ts", "event_id", "event_type", 86_400)


_CPU = "(SELECT event_id, user_id % 2 AS instance, event_type AS core, value, ts FROM events WHERE event_type <> 'error')"


def node_samples(spark, sf):
    """Events as samples of two instances: (cpu, memory)."""
    e = table(spark, sf, "events").withColumns({"instance": F.col("user_id") % 2, "tie": F.col("event_id")})
    mode = F.when(F.col("event_type") != "error", F.lit("idle")).otherwise(F.lit("user"))
    cpu = e.select("instance", F.col("event_type").alias("core"), mode.alias("mode"), "ts", "tie", "value")
    return cpu, e.select("instance", "ts", "tie", F.col("value").alias("available"), F.lit(500.0).alias("total"))


@query(
    "e19_utilization_cpu",
    f"WITH {asof_rate_sql('instance, core', _CPU)} SELECT instance, tick, round(1 - avg(grown / 300), 7) AS cpu_utilization FROM r GROUP BY ALL",
)
def utilization_cpu(spark, sf):
    return rounded(metrics.utilization(*node_samples(spark, sf))[0], "cpu_utilization", digits=7)


MEMORY_SQL = f"""m AS (SELECT user_id % 2 AS instance, ts, arg_max(value, event_id) AS available FROM events GROUP BY ALL),
     {grid_sql("instance", {"n": "1"}, "m")},
     s AS (SELECT *, make_timestamp(tick * 1000000) AS now FROM slots),
     used AS (SELECT s.instance, tick, 1 - available / 500.0 AS value FROM s ASOF JOIN m ON m.instance = s.instance AND s.now >= m.ts)"""


@query("e19_utilization_memory", f"WITH {MEMORY_SQL} SELECT instance, tick, round(value, 6) AS memory_utilization FROM used")
def utilization_memory(spark, sf):
    return rounded(metrics.utilization(*node_samples(spark, sf))[1], "memory_utilization")


_EVAL = """ev AS (SELECT user_id, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS tick, bool_and(value < 150) AS active FROM events GROUP BY ALL),
     st AS (SELECT *, tick - 86400 * row_number() OVER (PARTITION BY user_id, active ORDER BY tick) AS run FROM ev),
     sn AS (SELECT *, CASE WHEN active THEN min(tick) OVER (PARTITION BY user_id, active, run) END AS active_since FROM st)"""


@query(
    "f08_alerts_for",
    f"""WITH {_EVAL} SELECT user_id, tick, active_since,
          CASE WHEN NOT active THEN 'inactive' WHEN tick - active_since >= 172800 THEN 'firing' ELSE 'pending' END AS state FROM sn""",
)
def alerts_for(spark, sf):
    ev = alerts.evaluate(table(spark, sf, "events"), ["user_id"], "ts", F.col("value") < 150, 86_400)
    return alerts.alerts_for(ev, ["user_id"], 2 * 24 * 60, 86_400)
