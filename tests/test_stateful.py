"""Sequential operators against brute force, and streams against their batch twins."""

import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from gleanery.operators import alerts
from gleanery.sources import readers, writers
from gleanery.streaming import jobs, routing, stateful


@pytest.fixture(scope="module")
def log():
    """Requests of four clients, a third of them one client's, with many per second."""
    rng = random.Random(7)
    rows, t = [], {}
    for i in range(1500):
        client = "hot" if i % 3 == 0 else rng.choice("abc")
        t[client] = t.get(client, 1_700_000_000.0) + rng.choice([0, 0, 0.2, 1, 3, 20, 70 if client != "hot" else 1])
        rows.append((i * 7919 % 1500, client, t[client], rng.random() < 0.7))
    return rows


@pytest.fixture(scope="module")
def frame(spark, log):
    df = spark.createDataFrame(log, "id long, client string, t double, failed boolean")
    return df.withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long")))


def admitted(log, limit, seconds, once=False):
    held, out = {}, {}
    for i, client, t, _ in sorted(log, key=lambda r: (r[2], r[0])):
        now = int(t)
        active = [s for s in held.get(client, []) if s > now - seconds]
        out[i] = len(active) < limit
        if out[i] and not (once and now in active):
            active.append(now)
        held[client] = active
    return out


@pytest.mark.parametrize("limit, seconds", [(1, 60), (2, 60), (5, 1), (10, 60)])
def test_rate_limit(frame, log, limit, seconds):
    got = {r.id: r.allowed for r in stateful.rate_limit(frame, "client", "ts", "id", limit, seconds).collect()}
    assert got == admitted(log, limit, seconds)


@pytest.mark.parametrize("limit", [1, 2, 3])
def test_rate_limit_counting_a_second_once(frame, log, limit):
    got = {r.id: r.allowed for r in stateful.rate_limit(frame, "client", "ts", "id", limit, 60, per_second=True).collect()}
    assert got == admitted(log, limit, 60, once=True)


def test_rate_limit_window_is_open_at_its_start(spark):
    rows = [(0, "c", 100.0), (1, "c", 159.0), (2, "c", 160.0), (3, "c", 161.0)]
    df = spark.createDataFrame(rows, "id int, client string, t double").withColumn("ts", F.timestamp_seconds("t"))
    got = stateful.rate_limit(df, "client", "ts", "id", 1, 60).orderBy("id").collect()
    assert [r.allowed for r in got] == [True, False, True, False]
    assert [r.retry_after for r in got] == [None, 1, None, 59]
    assert [r.remaining for r in got] == [0, 0, 0, 0]


def openings(log, n, recover):
    out = []
    for client in {r[1] for r in log}:
        failures = until = 0
        for _, c, t, failed in sorted(log, key=lambda r: (r[2], r[0])):
            if c != client or int(t) < until:
                continue
            failures = failures + 1 if failed else 0
            if failures >= n:
                out.append((client, int(t), int(t) + recover))
                failures, until = 0, int(t) + recover
    return sorted(out)


@pytest.mark.parametrize("n, recover", [(1, 5), (3, 10), (5, 60)])
def test_breaker(frame, log, n, recover):
    got = stateful.breaker_intervals(frame, "client", "ts", "id", F.col("failed"), n, recover).collect()
    assert sorted(map(tuple, got)) == openings(log, n, recover)


LATE = 50


def write_stream(spark, path, rows, schema, at, last):
    """Files in about time order, some rows up to ``LATE`` seconds late, then two that move the watermark."""
    rng = random.Random(11)
    arrival = sorted(rows, key=lambda r: (r[at] + rng.choice([0, 0, 0, LATE]), rng.random()))
    size = -(-len(arrival) // 5)
    for chunk in [*(arrival[k : k + size] for k in range(0, len(arrival), size)), [last(10_000_000)], [last(10_000_001)]]:
        spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(path)


@pytest.fixture(scope="module")
def arriving(spark, frame, log, tmp_path_factory):
    """The log as a stream, with late rows and ids against the order of time."""
    path = str(tmp_path_factory.mktemp("arriving"))
    end = max(r[2] for r in log)
    write_stream(spark, path, log, "id long, client string, t double, failed boolean", 2, lambda s: (-s, "last", end + s, False))
    stream = spark.readStream.schema("id long, client string, t double, failed boolean").option("maxFilesPerTrigger", 1).parquet(path)
    return stream.withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long")))


@pytest.fixture(scope="module")
def complete(spark, frame, log):
    """What a stream over ``arriving`` has seen in the end."""
    end = max(r[2] for r in log)
    extra = spark.createDataFrame([(-s, "last", end + s, False) for s in (10_000_000, 10_000_001)], "id long, client string, t double, failed boolean")
    return frame.unionByName(extra.withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long"))))


def run(df, tmp_path, mode="append"):
    name = f"out_{abs(hash(str(tmp_path)))}"
    writer = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "state"))
    writer.trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name)


def left_in_state(spark, tmp_path):
    """Rows that the last batch kept in each state."""
    total = 0
    for name in ("waiting", "held", "breaker", "group", "members"):
        reader = spark.read.format("statestore").option("stateVarName", name)
        try:
            total += reader.option("flattenCollectionTypes", "true").load(str(tmp_path / "state")).filter("key.key NOT IN ('last', '+last')").count()
        except Exception as error:  # noqa: BLE001  a state that this operator lacks
            assert "STATE" in str(error).upper()
    return total


@pytest.mark.parametrize("limit, seconds", [(1, 60), (5, 60), (5, 1)])
def test_rate_limit_stream_equals_batch(arriving, frame, tmp_path, limit, seconds):
    got = run(stateful.rate_limit_stream(arriving, "client", "ts", "id", limit, seconds), tmp_path).filter("client <> 'last'")
    want = {r.id: r.allowed for r in stateful.rate_limit(frame, "client", "ts", "id", limit, seconds).collect()}
    rows = got.collect()
    assert {r.id: r.allowed for r in rows} == want and len(rows) == len(want)
    assert left_in_state(frame.sparkSession, tmp_path) == 0


def test_breaker_stream_equals_batch(arriving, frame, tmp_path):
    got = run(stateful.breaker_stream(arriving, "client", "ts", "id", F.col("failed"), 3, 10), tmp_path).collect()
    want = stateful.breaker_intervals(frame, "client", "ts", "id", F.col("failed"), 3, 10).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) != []


@pytest.mark.parametrize("ttl", [1, 60, 300])
def test_dedupe_stream_equals_batch(arriving, frame, tmp_path, ttl):
    got = run(stateful.dedupe_stream(arriving, "client", "ts", "id", ttl), tmp_path).filter("client <> 'last'")
    want = stateful.dedupe_with_ttl(frame, "client", "ts", "id", ttl)
    columns = ["id", "client", "t", "failed", "ts"]
    assert sorted(map(repr, got.select(columns).collect())) == sorted(map(repr, want.select(columns).collect())) != []
    assert left_in_state(frame.sparkSession, tmp_path) == 0


def test_dedupe_stream_keeps_events_without_a_key(spark, tmp_path):
    rows = [(0, None, 100), (1, None, 101), (2, "k", 100), (3, "k", 101), (3, "k", 101)]
    for chunk in (rows, [(8, "z", 9_000)], [(9, "z", 9_999)]):
        spark.createDataFrame(chunk, "id int, k string, t long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, k string, t long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run(stateful.dedupe_stream(stream.withColumn("ts", F.timestamp_seconds("t")), "k", "ts", "id"), tmp_path)
    assert sorted(r.id for r in got.collect() if r.id < 8) == [0, 1, 2]


def test_stream_metrics_equal_batch(arriving, complete, tmp_path):
    build = lambda df: jobs.stream_metrics(df, ["client"], "id", F.col("failed"))
    got = run(build(arriving), tmp_path, "complete").collect()
    want = build(complete).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_stream_rates_equal_batch(arriving, complete, tmp_path):
    build = lambda df: jobs.stream_rates(df, ["client"], "id", F.col("failed")).drop("p95_seconds")
    got = run(build(arriving), tmp_path, "complete").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, build(complete).collect()))


def test_latest_status_stream_equals_batch(arriving, complete, tmp_path):
    build = lambda df: jobs.latest_status(df, "client", "failed", "ts", "id")
    got = run(build(arriving), tmp_path, "complete").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, build(complete).collect()))


def test_availability_and_spikes_run_as_streams(arriving, complete, tmp_path):
    build = lambda df: jobs.availability(df, ["client"], ~F.col("failed"), 600, 300)
    got = run(build(arriving), tmp_path, "complete").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, build(complete).collect()))


def test_late_rows_are_dropped_after_the_watermark(spark, tmp_path):
    path = str(tmp_path / "in")
    # A batch is checked against the watermark of the batch before it.
    times = ["00:00:30", "02:00:00", "04:00:00", "00:00:40", "06:00:00"]
    for i, t in enumerate(times):
        row = spark.range(i, i + 1).select("id", F.to_timestamp(F.lit(f"2024-01-01 {t}")).alias("ts"))
        row.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    counts = run(jobs.stream_metrics(stream, [], "id", F.lit(False)), tmp_path)
    assert {(r.window.start.hour, r.events) for r in counts.collect()} == {(0, 1), (2, 1), (4, 1)}


def test_dedupe_with_ttl(spark):
    rows = [(0, "k", 0), (1, "k", 100), (2, "k", 299), (3, "k", 300), (4, "k", 599), (5, "j", 5)]
    df = spark.createDataFrame(rows, "id int, k string, t long").withColumn("ts", F.timestamp_seconds("t"))
    assert sorted(r.id for r in stateful.dedupe_with_ttl(df, "k", "ts", "id", 300).collect()) == [0, 3, 5]


def test_route_stream_is_idempotent(spark, tmp_path):
    rows = [("a", "execute", 0), ("b", "retry", 2), ("c", "retry", 3), ("d", "cancel", 0)]
    messages = spark.createDataFrame(rows, "task_id string, operation string, retry_count int").select(
        "task_id", F.lit("ocr").alias("task_type"), F.lit(datetime(2024, 1, 1)).alias("scheduled_at"), "operation", "retry_count", F.lit("boom").alias("error")
    )
    messages.write.json(str(tmp_path / "queue"))
    stream = readers.read_task_stream(spark, str(tmp_path / "queue")).withColumn("failed_at", F.col("scheduled_at"))
    for state in ("one", "two"):
        # A lost checkpoint replays the batch into the same folders.
        routing.write_routes(stream, str(tmp_path / "routes"), str(tmp_path / state)).awaitTermination()
    rows = spark.read.json(str(tmp_path / "routes")).collect()
    retry = {r.task_id: (r.retry_count, r.scheduled_at) for r in rows if r.route == "retry"}
    assert {k: v[0] for k, v in retry.items()} == {"a": 1, "b": 3}
    assert retry["b"][1].startswith("2024-01-01T00:04:00")
    assert sorted((r.task_id, r.route) for r in rows if r.route != "retry") == [("c", "dead_letter"), ("d", "cancel")]


def test_dedupe_keeps_events_without_a_key(spark):
    rows = [(0, None, 0), (1, None, 1), (2, "k", 0), (3, "k", 1)]
    df = spark.createDataFrame(rows, "id int, k string, t long").withColumn("ts", F.timestamp_seconds("t"))
    assert sorted(r.id for r in stateful.dedupe_with_ttl(df, "k", "ts", "id", 300).collect()) == [0, 1, 2]


def test_an_alert_does_not_fire_over_a_gap(spark):
    from gleanery.operators import alerts

    ticks = spark.createDataFrame([("a", 0, True), ("a", 3600, True), ("b", 0, True), ("b", 300, True)], "k string, tick long, active boolean")
    got = {(r.k, r.tick): (r.state, r.active_since) for r in alerts.alerts_for(ticks, ["k"], 5, 300).collect()}
    assert got[("a", 3600)] == ("pending", 3600) and got[("b", 300)] == ("firing", 0)


def test_log_stream_is_masked(spark, tmp_path):
    spark.createDataFrame([("m", "token=abc")], "logger string, message string").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("logger string, message string").json(str(tmp_path / "in"))
    writers.write_log_stream(jobs.mask_log_stream(stream), str(tmp_path / "out"), str(tmp_path / "state"), every=None).awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).first().message == "token=***MASKED***"


def notifications(rows, until, timeout=300):
    """Walk each group second by second of its alerts, flushes and ends."""
    out = []
    for severity in {r[0] for r in rows}:
        wait, repeat = {"critical": (0, 3600), "warning": (60, 21600)}.get(severity, (30, 14400))
        seen = sorted((t, f) for s, f, t in rows if s == severity)
        active, joined, waiting, flush, last, k = {}, 0, 0, None, None, 0
        now = seen[0][0]
        while now <= until:
            if flush is not None and max(active.values()) + timeout == now:
                out.append((severity, now, joined, 0, "resolved"))
                active, joined, waiting, flush, last = {}, 0, 0, None, None
            while k < len(seen) and seen[k][0] == now:
                f = seen[k][1]
                if f not in active or now - active[f] >= timeout:
                    joined, waiting = joined + 1, waiting + 1
                active[f] = now
                flush = now + wait if flush is None else flush
                k += 1
            if flush == now:
                if waiting or now - last >= repeat:
                    out.append((severity, now, joined, waiting, "new" if waiting else "repeat"))
                    waiting, last = 0, now
                flush += 300
            # The next moment at which anything can happen.
            moments = [x for x in (flush, max(active.values()) + timeout if active else None, seen[k][0] if k < len(seen) else None) if x is not None]
            if not moments:
                break
            now = max(min(moments), now + 1) if min(moments) <= now else min(moments)
    return sorted(out)


def alert_rows(seed, n, spread):
    """Alerts of three severities with members that come back, dense and sparse times."""
    rng, rows, t = random.Random(seed), [], 1_700_000_000
    for _ in range(n):
        t += rng.choice([0, 10, 60, 250, 299, 300, 301, spread])
        rows.append((rng.choice(["critical", "warning", "info"]), f"m{rng.randrange(4)}", t))
    return rows


def labelled(df):
    return df.select(
        F.lit("A").alias("alertname"), F.lit(None).cast("string").alias("cluster"), F.lit("s").alias("service"), "severity", "fingerprint", F.timestamp_seconds("t").alias("ts")
    )


@pytest.mark.parametrize("seed, spread", [(3, 20), (4, 700), (5, 5000)])
def test_group_alerts(spark, seed, spread):
    rows = alert_rows(seed, 250, spread)
    df = labelled(spark.createDataFrame(rows, "severity string, fingerprint string, t long"))
    for until in (rows[-1][2] + 50_000, rows[180][2] + 7):
        got = alerts.group_alerts(df.filter(F.unix_seconds("ts") <= until), datetime.fromtimestamp(until, timezone.utc)).collect()
        assert sorted((r.severity, r.notify_at, r.members, r.new_members, r.reason) for r in got) == notifications([r for r in rows if r[2] <= until], until)


def test_a_group_that_goes_on_is_repeated(spark):
    rows = [("critical", "m", 1_700_000_000 + 60 * k) for k in range(200)]
    df = labelled(spark.createDataFrame(rows, "severity string, fingerprint string, t long"))
    got = alerts.group_alerts(df, datetime.fromtimestamp(1_700_100_000, timezone.utc)).orderBy("notify_at").collect()
    assert [(r.notify_at - 1_700_000_000, r.reason, r.members) for r in got] == [
        (0, "new", 1), (3600, "repeat", 1), (7200, "repeat", 1), (10_800, "repeat", 1), (199 * 60 + 300, "resolved", 1)
    ]


def test_group_alerts_stream_equals_batch(spark, tmp_path):
    rows = alert_rows(6, 150, 900)
    end, path = rows[-1][2], str(tmp_path / "in")
    schema = "severity string, fingerprint string, t long"
    write_stream(spark, path, rows, schema, 2, lambda s: ("other", "x", end + s))
    stream = labelled(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path))
    got = run(stateful.group_alerts_stream(stream), tmp_path)
    want = alerts.group_alerts(labelled(spark.createDataFrame(rows, schema)), datetime.fromtimestamp(end + 9_000_000, timezone.utc))
    columns = sorted(want.columns)
    pick = lambda df: sorted(map(repr, df.filter("severity <> 'other'").select(columns).collect()))
    assert pick(got) == pick(want) != []
    kept = spark.read.format("statestore").option("stateVarName", "group").load(str(tmp_path / "state"))
    assert kept.filter("key.severity <> 'other'").count() == 0
