"""Stream operators in their batch form, and the custom-state ones as streams (H)."""

from pyspark.sql import functions as F

from gleanery.queries import query
from gleanery.queries.cleaning import mask_sql
from gleanery.queries.metrics import _histogram_sql, _quantile_sql, rounded
from gleanery.operators.metrics import API_BUCKETS
from gleanery.queries.sequences import _HISTORY, _history
from gleanery.queries.views import EXECUTIONS, REQUESTS, executions, requests, sql_time, table, time_text
from gleanery.streaming import jobs, stateful


def _opened(df):
    """The window start as text in place of the window."""
    start = time_text(F.col("window.start")).alias("window_start")
    return df.select(start, *[c for c in df.columns if c != "window"])


def _sliding(width_minutes: int, slide_minutes: int, source: str = "requests") -> str:
    """Each event once per sliding window that holds it."""
    slide = slide_minutes * 60
    steps = width_minutes // slide_minutes
    return f"""slid AS (SELECT *, (second // {slide} - k) * {slide} AS start_s FROM {source}, (SELECT unnest(range({steps})) AS k))"""


_START = "strftime(to_timestamp(start_s) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS window_start"


@query(
    "h01_dedupe_with_ttl",
    """WITH RECURSIVE kept AS (
         SELECT user_id, min(CAST(floor(epoch(ts)) AS BIGINT)) AS s FROM events GROUP BY user_id
         UNION ALL
         SELECT k.user_id, min(CAST(floor(epoch(e.ts)) AS BIGINT)) FROM kept k JOIN events e ON e.user_id = k.user_id AND CAST(floor(epoch(e.ts)) AS BIGINT) >= k.s + 86400
         GROUP BY k.user_id, k.s)
       SELECT k.user_id, k.s AS second, arg_min(e.event_id, (e.ts, e.event_id)) AS event_id
       FROM kept k JOIN events e ON e.user_id = k.user_id AND CAST(floor(epoch(e.ts)) AS BIGINT) = k.s GROUP BY ALL""",
)
def dedupe_with_ttl(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts")
    kept = stateful.dedupe_with_ttl(e, "user_id", "ts", "event_id", 86_400)
    return kept.select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("second"), "event_id")


@query(
    "h02_stream_metrics",
    f"""WITH {REQUESTS} SELECT {sql_time("date_trunc('minute', ts)")} AS window_start, endpoint, count(*) AS events, round(avg(seconds), 6) AS mean_value,
          count(*) FILTER (WHERE failed) AS errors FROM requests GROUP BY ALL""",
)
def stream_metrics(spark, sf):
    return rounded(_opened(jobs.stream_metrics(requests(spark, sf), ["endpoint"], "seconds", F.col("failed"))), "mean_value")


@query(
    "h03_stream_rates",
    f"""WITH {REQUESTS}, {_sliding(60, 15)} SELECT {_START}, endpoint, count(*) AS events, round(avg(seconds), 10) AS mean_seconds,
          list_extract(list_sort(list(seconds)), CAST(ceil(0.95 * count(*)) AS BIGINT)) AS p95_seconds,
          round(count(*) FILTER (WHERE failed) / count(*), 6) AS error_ratio, round(sum(length(props)) / 3600.0, 6) AS bytes_per_second FROM slid GROUP BY start_s, endpoint""",
)
def stream_rates(spark, sf):
    r = jobs.stream_rates(requests(spark, sf), ["endpoint"], "seconds", F.col("failed"), F.length("props"), 3600, 900)
    return rounded(rounded(_opened(r), "error_ratio", "bytes_per_second"), "mean_seconds", digits=10)


_HIST = _histogram_sql("slid", "seconds", API_BUCKETS, "start_s, endpoint")


@query(
    "h03_window_p95",
    f"""WITH {REQUESTS}, {_sliding(60, 15)}, h AS ({_HIST}), q AS ({_quantile_sql("WITH z AS (SELECT 1)", "start_s, endpoint", 0.95)})
        SELECT {_START}, endpoint, quantile FROM q""",
)
def window_p95(spark, sf):
    p = jobs.window_p95(requests(spark, sf), ["endpoint"], "seconds", width=3600, slide=900)
    return rounded(_opened(p), "quantile")


# With a limit of two, the two latest admissions decide: a request passes when
# the older of them has left the window.
_LATER = "w.a2 IS NULL OR w.a2 <= r.second - 43200"


@query(
    "h04_rate_limit",
    f"""WITH RECURSIVE {REQUESTS}, r AS (SELECT request_id, client, second, row_number() OVER (PARTITION BY client ORDER BY ts, request_id) AS n FROM requests),
        walk AS (
          SELECT request_id, client, second, n, true AS allowed, CAST(1 AS BIGINT) AS remaining, CAST(NULL AS BIGINT) AS retry_after,
                 second AS a1, CAST(NULL AS BIGINT) AS a2 FROM r WHERE n = 1
          UNION ALL
          SELECT r.request_id, r.client, r.second, r.n, {_LATER},
                 CASE WHEN ({_LATER}) AND w.a1 <= r.second - 43200 THEN 1 ELSE 0 END,
                 CASE WHEN NOT ({_LATER}) THEN w.a2 + 43200 - r.second END,
                 CASE WHEN {_LATER} THEN r.second ELSE w.a1 END, CASE WHEN {_LATER} THEN w.a1 ELSE w.a2 END
          FROM walk w JOIN r ON r.client = w.client AND r.n = w.n + 1)
        SELECT request_id, client, allowed, remaining, retry_after FROM walk""",
)
def rate_limit(spark, sf):
    r = requests(spark, sf).select("request_id", "client", "ts")
    out = stateful.rate_limit(r, "client", "ts", "request_id", 2, 43_200)
    return out.select("request_id", "client", "allowed", "remaining", "retry_after")


_FAILURES = "CASE WHEN r.second < w.until THEN w.failures WHEN r.bad THEN w.failures + 1 ELSE 0 END"
_OPENS = f"r.second >= w.until AND {_FAILURES} >= 5"


@query(
    "h06_breaker_intervals",
    f"""WITH RECURSIVE r AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS second, value < 60 AS bad,
             row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
        walk AS (
          SELECT user_id, second, n, CAST(bad AS BIGINT) AS failures, CAST(0 AS BIGINT) AS until, false AS opened FROM r WHERE n = 1
          UNION ALL
          SELECT r.user_id, r.second, r.n, CASE WHEN {_OPENS} THEN 0 ELSE {_FAILURES} END,
                 CASE WHEN {_OPENS} THEN r.second + 86400 ELSE w.until END, {_OPENS}
          FROM walk w JOIN r ON r.user_id = w.user_id AND r.n = w.n + 1)
        SELECT user_id, second AS opened_at, second + 86400 AS closes_at FROM walk WHERE opened""",
)
def breaker_intervals(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    return stateful.breaker_intervals(e, "user_id", "ts", "event_id", F.col("value") < 60, 5, 86_400)


@query(
    "h08_latest_status",
    f"WITH {_HISTORY} SELECT user_id, arg_max(status, (ts, event_id)) AS status, {sql_time('max(ts)')} AS updated_at FROM history GROUP BY user_id",
)
def latest_status(spark, sf):
    latest = jobs.latest_status(_history(spark, sf), "user_id", "status", "ts", "event_id")
    return latest.withColumn("updated_at", time_text("updated_at"))


@query(
    "h09_availability",
    f"""WITH {REQUESTS}, {_sliding(24 * 60, 60)} SELECT {_START}, endpoint, round(avg(CAST(seconds < 2 AS INTEGER)), 6) AS availability,
          avg(CAST(seconds < 2 AS INTEGER)) < 0.999 AS alert FROM slid GROUP BY start_s, endpoint""",
)
def availability(spark, sf):
    return rounded(_opened(jobs.availability(requests(spark, sf), ["endpoint"], F.col("seconds") < 2)), "availability")


@query(
    "h10_sla_breaches",
    f"WITH {EXECUTIONS} SELECT id, seconds FROM executions WHERE seconds > 300",
)
def sla_breaches(spark, sf):
    return jobs.sla_breaches(executions(spark, sf)).select("id", "seconds")


@query(
    "h11_auth_spikes",
    f"""WITH {REQUESTS} SELECT {sql_time("date_trunc('minute', ts)")} AS window_start, count(*) AS events FROM requests
        WHERE endpoint = 'signup' OR failed GROUP BY date_trunc('minute', ts) HAVING count(*) > 1""",
)
def auth_spikes(spark, sf):
    return _opened(jobs.auth_spikes(requests(spark, sf), (F.col("endpoint") == "signup") | F.col("failed"), above=1))


@query(
    "h12_error_spike",
    f"""WITH {REQUESTS} SELECT {sql_time("date_trunc('minute', ts)")} AS window_start, endpoint, count(*) AS events FROM requests
        WHERE seconds > 0.1 GROUP BY date_trunc('minute', ts), endpoint HAVING count(*) > 1""",
)
def error_spike(spark, sf):
    return _opened(jobs.error_spike(requests(spark, sf), F.col("seconds") > 0.1, ["endpoint"], above=1))


@query("h13_mask_log_stream", f"SELECT conv_id, turn, {mask_sql('text')} AS message, '***MASKED***' AS token, role FROM conversations")
def mask_log_stream(spark, sf):
    extra = F.create_map(F.lit("user_token"), F.col("role"), F.lit("role"), F.col("role"))
    logs = table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("message"), extra.alias("extra"))
    masked = jobs.mask_log_stream(logs, extra="extra")
    return masked.select("conv_id", "turn", "message", F.col("extra")["user_token"].alias("token"), F.col("extra")["role"].alias("role"))
