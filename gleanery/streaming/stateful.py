"""Sequential decisions per key: admission, circuit breaking.

Whether a request is admitted depends on the admissions before it, so no window
frame gives the answer. Both forms work in whole seconds, the resolution of the
limits themselves. The batch form first reduces each key to one row per second
with map-side aggregation: a key's sequence is then bounded by the time it
spans and not by its rows, and only that reduced sequence is walked. The
streaming form keeps the same state between micro-batches.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gleanery.functions.values import epoch_seconds
from gleanery.operators.alerts import GROUP_INTERVAL, GROUP_LABELS, RESOLVE_TIMEOUT, route_alerts
from gleanery.plans import slices

# The default limits.
MAX_REQUESTS = 1000
WINDOW_SECONDS = 3600
FAILURE_THRESHOLD = 5
RECOVERY_SECONDS = 60


class SlidingQuota:
    """Admitted requests of the last ``seconds``, as (second, admitted) pairs."""

    def __init__(self, limit: int, seconds: int, once_per_second: bool, held: Iterable[tuple[int, int]] = ()) -> None:
        self.limit, self.seconds, self.once = limit, seconds, once_per_second
        self.held = deque(held)
        self.used = sum(n for _, n in self.held)

    def offer(self, second: int, wanted: int) -> tuple[int, int, int]:
        """(admitted, quota used before, oldest second held) for ``wanted`` requests."""
        while self.held and self.held[0][0] <= second - self.seconds:
            self.used -= self.held.popleft()[1]
        before = self.used
        room = max(self.limit - before, 0)
        if self.once:
            # A second takes one place, however many requests it admits.
            admitted = wanted if room > 1 else min(wanted, room)
            taken = min(admitted, 1)
        else:
            admitted = taken = min(wanted, room)
        if taken:
            self.held.append((second, taken))
            self.used += taken
        return admitted, before, self.held[0][0] if self.held else second


def admission_counts(requests: DataFrame, client: str, ts: str, limit: int = MAX_REQUESTS, seconds: int = WINDOW_SECONDS, per_second: bool = False) -> DataFrame:
    """Per client and second: requests, how many are admitted, quota used before.

    Requests without a client belong to no quota and are left out.
    """
    if limit < 1 or seconds < 1:
        raise ValueError("limit and window must be positive")
    counts = requests.groupBy(client, epoch_seconds(F.col(ts)).alias("second")).agg(F.count("*").alias("requests"))

    def walk(batches):
        current, quota = object(), None
        for pdf in batches:
            decided = []
            for key, second, wanted in zip(pdf[client].tolist(), pdf["second"].tolist(), pdf["requests"].tolist()):
                if key != current:
                    current, quota = key, SlidingQuota(limit, seconds, per_second)
                decided.append(quota.offer(second, wanted))
            yield pdf.assign(**{name: [d[i] for d in decided] for i, name in enumerate(("admitted", "used_before", "oldest"))})

    kind = requests.schema[client].dataType.simpleString()
    schema = f"`{client}` {kind}, second long, requests long, admitted long, used_before long, oldest long"
    return _in_sequence(counts, client).mapInPandas(walk, schema)


def _in_sequence(per_second: DataFrame, key: str) -> DataFrame:
    """Whole keys per task, each in time order: tasks stream through them, holding one state."""
    return per_second.filter(F.col(key).isNotNull()).repartition(F.col(key)).sortWithinPartitions(key, "second")


def rate_limit(requests: DataFrame, client: str, ts: str, tie: str, limit: int = MAX_REQUESTS, seconds: int = WINDOW_SECONDS, per_second: bool = False) -> DataFrame:
    """Admit a request if fewer than ``limit`` were admitted in ``(t - seconds, t]``.

    Rejected requests are not recorded. Adds ``allowed``, ``remaining`` and, for
    rejected ones, ``retry_after`` in seconds. ``per_second=True`` counts all the
    requests of one second as one.
    """
    counts = admission_counts(requests, client, ts, limit, seconds, per_second).drop("requests")
    # A second of a client may hold very many requests, so it is cut into slices too.
    known = requests.withColumn("second", epoch_seconds(F.col(ts))).filter(F.col(client).isNotNull() & F.col("second").isNotNull())
    placed = slices.number_rows(slices.by_range(known, [client, "second"], [ts, tie]), [client, "second"], [ts, tie], "__place")
    allowed = F.col("__place") <= F.col("admitted")
    taken = F.least("__place", "admitted")
    if per_second:
        taken = F.least(taken, F.lit(1).cast("long"))
    remaining = F.greatest(F.lit(limit) - F.col("used_before") - taken, F.lit(0).cast("long"))
    return (
        placed.join(counts, [client, "second"])
        .withColumns(
            {
                "allowed": allowed,
                "remaining": remaining,
                "retry_after": F.when(~allowed, F.col("oldest") + F.lit(seconds) - F.col("second")),
            }
        )
        .drop("__place", "admitted", "used_before", "oldest", "second")
    )


def dedupe_with_ttl(df: DataFrame, key: str, ts: str, tie: str, ttl_seconds: int = 300) -> DataFrame:
    """Keep an event unless one was kept for its key less than ``ttl`` before: a quota of one.

    Events without a key are duplicates of nothing and stay.
    """
    kept = rate_limit(df, key, ts, tie, 1, ttl_seconds).filter("allowed").select(*df.columns)
    return kept.unionByName(df.filter(F.col(key).isNull()))


class Breaker:
    """Counts consecutive failures; open for ``recover`` seconds after the n-th."""

    def __init__(self, n: int, recover: int, failures: int = 0, open_until: int = 0) -> None:
        self.n, self.recover = n, recover
        self.failures, self.open_until = failures, open_until

    def second(self, at: int, leading: int, inner: int, trailing: int, succeeded: bool) -> bool:
        """One second of outcomes; true if the breaker opens in it.

        ``leading`` failures come before the first success, ``trailing`` after the
        last, ``inner`` is the longest run after the first.
        """
        if at < self.open_until:
            return False
        if self.failures + leading >= self.n or (succeeded and inner >= self.n):
            self.failures, self.open_until = 0, at + self.recover
            return True
        self.failures = trailing if succeeded else self.failures + leading
        return False


def breaker_intervals(outcomes: DataFrame, key: str, ts: str, tie: str, failed: Column, n: int = FAILURE_THRESHOLD, recover: int = RECOVERY_SECONDS) -> DataFrame:
    """``(key, opened_at, closes_at)`` in epoch seconds, from the outcome log.

    A success resets the count, the n-th failure in a row opens, outcomes while
    open are refused calls and ignored, and closing starts from zero.
    """
    rows = outcomes.select(
        key, epoch_seconds(F.col(ts)).alias("second"), ts, tie, F.coalesce(failed, F.lit(False)).alias("failed")
    )
    succeeded = F.when(F.col("failed"), F.lit(0)).otherwise(F.lit(1))
    known = rows.filter(F.col(key).isNotNull() & F.col("second").isNotNull())
    numbered = slices.running(
        slices.by_range(known, [key, "second"], [ts, tie]), [key, "second"], [ts, tie], {"run": slices.Running("sum", succeeded)}
    )
    runs = numbered.groupBy(key, "second", "run").agg(F.count_if("failed").alias("f"))
    zero = F.lit(0).cast("long")
    seconds = runs.groupBy(key, "second").agg(
        F.coalesce(F.max(F.when(F.col("run") == 0, F.col("f"))), zero).alias("leading"),
        F.coalesce(F.max(F.when(F.col("run") > 0, F.col("f"))), zero).alias("inner"),
        F.max_by("f", "run").alias("trailing"),
        (F.max("run") > 0).alias("succeeded"),
    )

    def walk(batches):
        import pandas as pd

        current, breaker = object(), None
        columns = [key, "second", "leading", "inner", "trailing", "succeeded"]
        for pdf in batches:
            hits = []
            for name, *outcome in zip(*[pdf[c].tolist() for c in columns]):
                if name != current:
                    current, breaker = name, Breaker(n, recover)
                if breaker.second(*outcome):
                    hits.append((name, outcome[0], outcome[0] + recover))
            yield pd.DataFrame(hits, columns=[key, "opened_at", "closes_at"])

    kind = outcomes.schema[key].dataType.simpleString()
    return _in_sequence(seconds, key).mapInPandas(walk, f"`{key}` {kind}, opened_at long, closes_at long")


# --- streams ---------------------------------------------------------------


class _InOrder(StatefulProcessor):
    """Keeps a key's rows until the watermark has passed them, then judges them by time and id.

    So a stream decides as the batch form does, whatever the order of arrival; only rows
    later than the watermark are lost. A subclass says in ``wake`` until when its state
    matters; a key with nothing waiting and nothing to remember leaves the store.
    """

    columns: Sequence[str] = ()

    def __init__(self, waiting: str) -> None:
        self.schema = waiting

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)

    def handleInputRows(self, key, rows, timerValues):
        new = [tuple(r) for pdf in rows for r in zip(*(pdf[c].tolist() for c in self.names()))]
        if new:
            self.waiting.appendList(new)
            self._wake_at(min(r[0] for r in new))
        yield self.frame([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get(), key=lambda r: r[:2])
        due = [r for r in rows if r[0] <= passed]
        if due:
            if len(due) < len(rows):
                self.waiting.put([tuple(r) for r in rows[len(due) :]])
            else:
                self.waiting.clear()
        out = list(self.judge(key, due, passed // 1_000_000))
        wake = self.wake(passed // 1_000_000)
        if len(due) < len(rows):
            self._wake_at(rows[len(due)][0])
        if wake is not None:
            self._wake_at(wake * 1_000_000)
        yield self.frame(out)

    def _wake_at(self, micros: int) -> None:
        self.handle.registerTimer(-(-int(micros) // 1000))

    def names(self) -> list[str]:
        return [c.strip().rsplit(" ", 1)[0].strip("`") for c in self.schema.split(",")]

    def frame(self, rows: list[tuple]):
        import pandas as pd

        return pd.DataFrame(rows, columns=list(self.columns))

    def close(self) -> None:
        pass


def _held(df: DataFrame, ts: str, lateness: str) -> DataFrame:
    """With event time as a timestamp, its watermark, and ``micros``."""
    timed = df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    return timed.withColumn("micros", F.unix_micros(ts)).filter(F.col("micros").isNotNull())


def _run(df: DataFrame, keys: Sequence[str], processor: StatefulProcessor, schema: str) -> DataFrame:
    return df.groupBy(*keys).transformWithStateInPandas(processor, outputStructType=schema, outputMode="append", timeMode="eventTime")


class _Admission(_InOrder):
    columns = ("key", "tie", "second", "allowed", "payload")

    def __init__(self, waiting: str, limit: int, seconds: int, per_second: bool, only_allowed: bool) -> None:
        super().__init__(waiting)
        self.settings, self.only_allowed = (limit, seconds, per_second), only_allowed

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.held = handle.getValueState("held", "seconds array<bigint>, counts array<bigint>")

    def judge(self, key, rows, now):
        state = self.held.get()
        quota = SlidingQuota(*self.settings, held=zip(*state) if state else ())
        for micros, tie, payload in rows:
            second = micros // 1_000_000
            allowed = bool(quota.offer(second, 1)[0])
            if allowed or not self.only_allowed:
                yield key[0], tie, second, allowed, payload
        self.newest = quota.held[-1][0] if quota.held else None
        if quota.held:
            self.held.update(([int(s) for s, _ in quota.held], [int(c) for _, c in quota.held]))

    def wake(self, now):
        if self.newest is None or self.newest <= now - self.settings[1]:
            self.held.clear()
            return None
        return self.newest + self.settings[1]


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def rate_limit_stream(
    requests: DataFrame, client: str, ts: str, tie: str, limit: int = MAX_REQUESTS, seconds: int = WINDOW_SECONDS, lateness: str = "1 minute"
) -> DataFrame:
    """Admission on a stream, ``(client, tie, second, allowed)``, equal to :func:`rate_limit`.

    A request is decided once the watermark has passed it, in the order of time and id.
    State per client is its requests of ``lateness`` and its admissions inside the window,
    at most ``limit``; afterwards the client is forgotten. Needs the RocksDB state store.
    """
    held = _held(requests, ts, lateness).filter(F.col(client).isNotNull())
    slim = held.select(F.col(client).alias("key"), "micros", F.col(tie).alias("tie"), F.lit(None).cast("string").alias("payload"), ts)
    processor = _Admission(f"micros bigint, tie {_kind(slim, 'tie')}, payload string", limit, seconds, False, False)
    out = _run(slim, ["key"], processor, f"key {_kind(slim, 'key')}, tie {_kind(slim, 'tie')}, second long, allowed boolean, payload string")
    return out.select(F.col("key").alias(client), F.col("tie").alias(tie), "second", "allowed")


_EXACT_TIME = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def dedupe_stream(df: DataFrame, key: str, ts: str, tie: str, ttl_seconds: int = 300, lateness: str = "1 minute") -> DataFrame:
    """:func:`dedupe_with_ttl` on a stream, with the rows' own columns.

    A key is free again exactly ``ttl`` after the event that was kept, in event time, and
    then leaves the state. Events without a key are duplicates of nothing and stay.
    """
    names = df.columns
    whole = F.to_json(F.struct(*names), _EXACT_TIME)
    held = _held(df.withColumn("__whole", whole), ts, lateness)
    # A row without a key is a key of its own.
    alone = F.concat(F.lit("-"), F.col(tie).cast("string"), F.lit("|"), F.col("__whole"))
    slim = held.select(
        F.coalesce(F.concat(F.lit("+"), F.col(key).cast("string")), alone).alias("key"), "micros", F.col(tie).alias("tie"), F.col("__whole").alias("payload"), ts
    )
    processor = _Admission(f"micros bigint, tie {_kind(slim, 'tie')}, payload string", 1, ttl_seconds, False, True)
    out = _run(slim, ["key"], processor, f"key string, tie {_kind(slim, 'tie')}, second long, allowed boolean, payload string")
    return out.select(F.from_json("payload", df.schema, _EXACT_TIME).alias("r")).select("r.*")


class _Breaking(_InOrder):
    columns = ("key", "opened_at", "closes_at")

    def __init__(self, waiting: str, n: int, recover: int) -> None:
        super().__init__(waiting)
        self.settings = (n, recover)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("breaker", "failures bigint, open_until bigint")

    def judge(self, key, rows, now):
        self.breaker = breaker = Breaker(*self.settings, *(self.state.get() or (0, 0)))
        for micros, _, failed in rows:
            second = micros // 1_000_000
            if breaker.second(second, int(failed), 0, 0, not failed):
                yield key[0], second, second + breaker.recover
        self.state.update((int(breaker.failures), int(breaker.open_until)))

    def wake(self, now):
        if self.breaker.failures == 0 and self.breaker.open_until <= now:
            self.state.clear()
        return self.breaker.open_until if self.breaker.open_until > now else None


def breaker_stream(
    outcomes: DataFrame, key: str, ts: str, tie: str, failed: Column, n: int = FAILURE_THRESHOLD, recover: int = RECOVERY_SECONDS, lateness: str = "1 minute"
) -> DataFrame:
    """Breaker openings on a stream, equal to :func:`breaker_intervals`.

    Outcomes are counted once the watermark has passed them. A closed breaker without
    failures leaves the state. Needs the RocksDB state store.
    """
    held = _held(outcomes, ts, lateness).filter(F.col(key).isNotNull())
    slim = held.select(F.col(key).alias("key"), "micros", F.col(tie).alias("tie"), F.coalesce(failed, F.lit(False)).alias("failed"), ts)
    processor = _Breaking(f"micros bigint, tie {_kind(slim, 'tie')}, failed boolean", n, recover)
    return _run(slim, ["key"], processor, f"key {_kind(slim, 'key')}, opened_at long, closes_at long").withColumnRenamed("key", key)


class _Notifier(_InOrder):
    """One notification group: who is active, how many joined, when it flushes and ends."""

    columns = (*GROUP_LABELS, "severity", "receiver", "dedup_key", "notify_at", "members", "new_members", "reason")

    def __init__(self, waiting: str, interval: int, timeout: int) -> None:
        super().__init__(waiting)
        self.interval, self.timeout = interval, timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.members = handle.getMapState("members", "fingerprint string", "last bigint")
        self.group = handle.getValueState("group", "waiting bigint, members bigint, last_sent bigint, flush bigint, ended bigint, route string")

    def judge(self, key, rows, now):
        state = self.group.get()
        self.life = list(state) if state else None
        for micros, fingerprint, wait, route in rows:
            second = micros // 1_000_000
            yield from self._advance(key, second - 1, second)
            last = self.members.getValue((fingerprint,)) if self.members.containsKey((fingerprint,)) else None
            if self.life is None:
                self.life = [0, 0, 0, second + wait, 0, route]
            if last is None or second - last[0] >= self.timeout:
                self.life[0] += 1
            self.members.updateValue((fingerprint,), (int(second),))
            self.life[4] = max(self.life[4], second + self.timeout)
        # Rows of the watermark's own second may still come.
        yield from self._advance(key, now - 1, now)
        if self.life is not None:
            self.group.update(tuple(x if isinstance(x, str) else int(x) for x in self.life))
            for member in [m for m, last in self.members.iterator() if last[0] + self.timeout <= now - self.timeout]:
                self.members.removeKey(member)

    def _advance(self, key, flushed: int, ended: int):
        """Flushes up to one second and the group's end up to another."""
        while self.life is not None:
            waiting, members, last_sent, flush, end, route = self.life
            receiver, dedup_key, repeat = route.split("\x1f")
            if end <= flush and end <= ended:
                if last_sent:
                    yield *key, receiver, dedup_key, end, members, 0, "resolved"
                self.life = None
                self.group.clear()
                self.members.clear()
            elif flush < end and flush <= flushed:
                if waiting or flush - last_sent >= int(repeat):
                    yield *key, receiver, dedup_key, flush, members + waiting, waiting, "new" if waiting else "repeat"
                    last_sent = flush
                self.life = [0, members + waiting, last_sent, flush + self.interval, end, route]
            else:
                return

    def wake(self, now):
        if self.life is None:
            return None
        return min(self.life[3] + 1, self.life[4])


def group_alerts_stream(alerts: DataFrame, lateness: str = "1 minute", interval: int = GROUP_INTERVAL, timeout: int = RESOLVE_TIMEOUT) -> DataFrame:
    """Notifications of ``operators.alerts.group_alerts`` as the watermark passes their time.

    ``alerts`` is ``(alertname, cluster, service, severity, fingerprint, ts)``. A group
    whose members have all ended leaves the state. Needs the RocksDB state store.
    """
    routed = route_alerts(_held(alerts, "ts", lateness))
    route = F.concat_ws("\x1f", "receiver", "dedup_key", F.col("repeat_interval").cast("string"))
    slim = routed.select(*GROUP_LABELS, "severity", "micros", "fingerprint", F.col("group_wait").cast("long").alias("wait"), route.alias("route"), "ts")
    labels = ", ".join(f"{c} string" for c in (*GROUP_LABELS, "severity"))
    processor = _Notifier("micros bigint, fingerprint string, wait bigint, route string", interval, timeout)
    schema = f"{labels}, receiver string, dedup_key string, notify_at long, members long, new_members long, reason string"
    return _run(slim, [*GROUP_LABELS, "severity"], processor, schema)
