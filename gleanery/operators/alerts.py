"""Alert evaluation, inhibition, grouping and routing."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.functions.values import epoch_seconds, utc
from gleanery.plans import slices

# Labels that make up a notification group.
GROUP_LABELS = ("alertname", "cluster", "service")
# Receiver, first wait and repeat interval in seconds per severity.
ROUTES = {
    "critical": ("pagerduty-critical", 0, 3600),
    "warning": ("email-warnings", 60, 6 * 3600),
}
DEFAULT_ROUTE = ("default-receiver", 30, 4 * 3600)
GROUP_INTERVAL = 300
# Fixed value: seconds after which an alert that was not seen again has ended.
RESOLVE_TIMEOUT = 300


def evaluate(df: DataFrame, keys: Sequence[str], ts: str, condition: Column, interval: int = 15) -> DataFrame:
    """One row per key and evaluation tick: ``active`` if the condition held for all its rows."""
    tick = F.floor(epoch_seconds(F.col(ts)) / F.lit(interval)) * F.lit(interval)
    return df.groupBy(*keys, tick.alias("tick")).agg(F.bool_and(F.coalesce(condition, F.lit(False))).alias("active"))


def alerts_for(evaluations: DataFrame, keys: Sequence[str], minutes: float, interval: int = 15) -> DataFrame:
    """State per evaluation: inactive, pending, or firing once active for ``minutes``.

    Works on :func:`evaluate` output of the same ``interval`` in seconds: one row per
    tick bounds a key by time. A tick without an evaluation ends a run, as the condition
    was not seen to hold there.
    """
    order = Window.partitionBy(*keys).orderBy("tick")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gap = F.coalesce(F.col("tick") - F.lag("tick").over(order) > interval, F.lit(False))
    starts = evaluations.withColumn("__gap", gap)
    runs = starts.withColumn("__run", F.count_if(~F.col("active") | F.col("__gap")).over(upto)).drop("__gap")
    start = F.min(F.when(F.col("active"), F.col("tick"))).over(Window.partitionBy(*keys, "__run"))
    state = (
        F.when(~F.col("active"), F.lit("inactive"))
        .when(F.col("tick") - F.col("active_since") >= minutes * 60, F.lit("firing"))
        .otherwise(F.lit("pending"))
    )
    return (
        runs.withColumn("active_since", F.when(F.col("active"), start)).withColumn("state", state).drop("__run", "active")
    )


def inhibit(alerts: DataFrame, labels: Sequence[str] = GROUP_LABELS) -> DataFrame:
    """Drop warnings whose labels equal those of a critical alert; null equals null."""
    critical = (
        alerts.filter(F.col("severity") == "critical")
        .select(*[F.col(c).alias(f"__{c}") for c in labels])
        .distinct()
    )
    same = F.col("severity") == "warning"
    for c in labels:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return alerts.join(critical, same, "left_anti")


def _route(index: int) -> Column:
    choice = F.lit(DEFAULT_ROUTE[index])
    for severity, route in ROUTES.items():
        choice = F.when(F.col("severity") == severity, F.lit(route[index])).otherwise(choice)
    return choice


def route_alerts(alerts: DataFrame) -> DataFrame:
    """Receiver, waits and deduplication key by severity."""
    return alerts.withColumns(
        {
            "receiver": _route(0),
            "group_wait": _route(1),
            "repeat_interval": _route(2),
            "dedup_key": F.concat_ws("_", "alertname", "service"),
        }
    )


def member_spans(alerts: DataFrame, labels: Sequence[str], fingerprint: str, ts: str, timeout: int = RESOLVE_TIMEOUT) -> DataFrame:
    """(labels, fingerprint, joined, ended): when each member was active, in epoch seconds.

    A member is active from an alert until ``timeout`` after its last one; alerts that
    follow each other sooner make one span.
    """
    keys = [*labels, fingerprint]
    seen = alerts.select(*keys, epoch_seconds(F.col(ts)).alias("second")).filter("second IS NOT NULL").distinct()
    linked = slices.running(slices.by_range(seen, keys, ["second"]), keys, ["second"], {"__prev": slices.Running("prev", F.col("second"))}, keep_slices=True)
    starts = F.col("__prev").isNull() | (F.col("second") - F.col("__prev") >= timeout)
    flagged = linked.withColumn("__start", F.when(starts, F.col("second"))).drop("__prev")
    spans = slices.running(flagged, keys, ["second"], {"joined": slices.Running("max", F.col("__start"))})
    return spans.groupBy(*keys, "joined").agg((F.max("second") + timeout).alias("ended"))


def group_lives(spans: DataFrame, labels: Sequence[str]) -> DataFrame:
    """(labels, joined, n, ended, first_seen): spans per second, and when their group began.

    A group lives as long as any of its members is active; one that joins at the moment
    the last has ended begins another life.
    """
    per_second = spans.groupBy(*labels, "joined").agg(F.count("*").alias("n"), F.max("ended").alias("ended"))
    in_order = lambda df: slices.by_range(df, labels, ["joined"])
    upto = slices.running(in_order(per_second), labels, ["joined"], {"__upto": slices.Running("max", F.col("ended"))}, keep_slices=True)
    before = slices.running(upto, labels, ["joined"], {"__before": slices.Running("prev", F.col("__upto"))})
    begins = F.col("__before").isNull() | (F.col("joined") >= F.col("__before"))
    begun = before.withColumn("__begin", F.when(begins, F.col("joined"))).drop("__upto", "__before")
    return slices.running(in_order(begun), labels, ["joined"], {"first_seen": slices.Running("max", F.col("__begin"))}).drop("__begin")


def group_alerts(
    alerts: DataFrame, until: datetime, fingerprint: str = "fingerprint", ts: str = "ts", interval: int = GROUP_INTERVAL, timeout: int = RESOLVE_TIMEOUT
) -> DataFrame:
    """Notifications per group ``(alertname, cluster, service, severity)`` up to ``until``.

    A group flushes ``group_wait`` after its first alert and then every ``interval``, while
    any member is active. A flush notifies when members joined since the last
    notification, or when ``repeat_interval`` has passed since it; once the last member
    has ended, the group is notified as resolved and begins anew with the next alert.
    ``members`` counts those that joined in the group's life. Flush times follow from
    the first alert of a life alone, so members are aggregated per flush and repeats are
    generated between two of them; no group is walked row by row.
    """
    labels = [*GROUP_LABELS, "severity"]
    lives = group_lives(member_spans(alerts, labels, fingerprint, ts, timeout), labels)
    life = [*labels, "first_seen"]
    routed = route_alerts(lives)
    names = [*life, "receiver", "group_wait", "repeat_interval", "dedup_key"]
    flush_0 = F.col("first_seen") + F.col("group_wait")
    tick = F.greatest(F.lit(0), F.ceil((F.col("joined") - flush_0) / F.lit(interval)))
    # Two levels, so that a life with very many joins is reduced on the map side.
    flushes = routed.groupBy(*names, tick.alias("tick")).agg(F.sum("n").alias("new_members"), F.max("ended").alias("ended"))

    end = int(utc(until).timestamp())
    whole = Window.partitionBy(*life)
    order = whole.orderBy("tick")
    ended = F.max("ended").over(whole)
    last_tick = F.floor((F.least(F.lit(end), F.col("__ended") - 1) - flush_0) / F.lit(interval))
    next_tick = F.least(F.coalesce(F.lead("tick").over(order), last_tick + 1), last_tick + 1)
    step = F.ceil(F.col("repeat_interval") / F.lit(interval))
    total = F.sum("new_members").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    spans = flushes.withColumn("__ended", ended).withColumns({"__next": next_tick, "__step": step, "members": total, "__last": last_tick})
    sent = spans.filter(F.col("tick") <= F.col("__last")).withColumn("__at", F.explode(F.sequence("tick", F.col("__next") - 1, "__step")))
    first = F.col("__at") == F.col("tick")
    zero = F.lit(0).cast("long")
    columns = [*labels, "receiver", "dedup_key", "notify_at", "members", "new_members", "reason"]
    open_ = sent.withColumns(
        {
            "notify_at": flush_0 + F.col("__at") * interval,
            "new_members": F.when(first, F.col("new_members")).otherwise(zero),
            "reason": F.when(first, F.lit("new")).otherwise(F.lit("repeat")),
        }
    )
    over = flushes.groupBy(*names).agg(F.max("ended").alias("notify_at"), F.sum("new_members").alias("members"))
    over = over.filter((F.col("notify_at") <= end) & (F.col("notify_at") > flush_0))
    return open_.select(columns).unionByName(over.withColumns({"new_members": zero, "reason": F.lit("resolved")}).select(columns))
