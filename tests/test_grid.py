"""Samples on common ticks, and the alerting rules on them, against walks tick by tick."""

import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from gleanery.operators import metrics, monitoring
from gleanery.plans import grid

START = 1_700_000_100


def timed(spark, rows, schema):
    return spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_micros(F.round(F.col("t") * 1e6).cast("long")))


@pytest.fixture(scope="module")
def samples():
    """Counters of five series with gaps, resets, equal moments and a hot series."""
    r, rows = random.Random(1), []
    for series in ("a", "b", "c", "hot", None):
        t, value = float(START), 0.0
        for _ in range(400 if series == "hot" else 40):
            t = round(t + (r.choice([0, 0.4, 7, 15, 40, 290, 301, 900]) if series != "hot" else r.choice([0, 1, 3])), 1)
            value = value + r.randrange(20) if r.random() < 0.9 else float(r.randrange(5))
            rows.append((series, t, len(rows), value))
    return rows


def ticks_of(rows, step, lookback):
    """Per key the ticks with a row in (tick - lookback, tick]."""
    first, last = min(t for _, t, *_ in rows), max(t for _, t, *_ in rows) + lookback
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        tick = int(first // step) * step
        while tick <= last:
            inside = [r for r in own if tick - lookback < r[1] <= tick]
            if inside:
                yield key, tick, own, inside
            tick += step


def growth(own):
    """(moment, growth since the sample before) with resets counted from zero."""
    return [(b[1], b[3] - a[3] if b[3] >= a[3] else b[3]) for a, b in zip(own, own[1:])]


@pytest.mark.parametrize("step, seconds", [(15, 300), (60, 300), (15, 15)])
def test_grid_rate(spark, samples, step, seconds):
    df = timed(spark, samples, "k string, t double, id long, value double")
    got = {(r.k, r.tick): round(r.rate * seconds, 6) for r in metrics.grid_rate(df, ["k"], "ts", "id", "value", seconds, step).collect()}
    want = {(k, tick): sum(g for t, g in growth(own) if tick - seconds < t <= tick) for k, tick, own, _ in ticks_of(samples, step, seconds)}
    assert got == want


def test_series_sampled_at_different_seconds_add_up_at_every_tick(spark):
    rows = [("x", START + 10 * k + 1.5, k, 2.0 * k) for k in range(60)] + [("y", START + 14 * k + 5.0, k, 7.0 * k) for k in range(40)]
    df = timed(spark, rows, "k string, t double, id long, value double").withColumn("g", F.lit(1))
    got = {r.tick: r.rate for r in metrics.request_rates(df, ["g"], ["g", "k"], "ts", "id", "value", 60).collect()}
    # Both series grow steadily: 0.2 and 0.5 a second, give or take a sample at an edge.
    inner = [v for t, v in got.items() if START + 120 <= t <= START + 480]
    assert len(inner) == 25 and all(0.7 - 9 / 60 <= v <= 0.7 + 9 / 60 for v in inner)


def test_rates_are_added_up_before_rows_are_repeated(spark, samples, monkeypatch):
    """Rows are repeated at later ticks for the group and not for each of its series."""
    rows = [(k if k is None else "g", str(k), *rest) for k, *rest in samples]
    df = timed(spark, rows, "g string, k string, t double, id long, value double")
    repeated, plain = [], grid.filled
    monkeypatch.setattr(grid, "filled", lambda ticks, keys, *rest: (repeated.append(list(keys)), plain(ticks, keys, *rest))[1])
    got = {(r.g, r.tick): round(r.rate * 300, 6) for r in metrics.request_rates(df, ["g"], ["g", "k"], "ts", "id", "value").collect()}
    assert repeated == [["g"]]
    want = {}
    for k, tick, own, _ in ticks_of(samples, 15, 300):
        key = (k if k is None else "g", tick)
        want[key] = want.get(key, 0) + sum(g for t, g in growth(own) if tick - 300 < t <= tick)
    assert got == want
    with pytest.raises(ValueError):
        metrics.request_rates(df, ["id"], ["g", "k"], "ts", "id", "value")


def test_last_values(spark, samples):
    df = timed(spark, samples, "k string, t double, id long, value double")
    got = {(r.k, r.tick): r.value for r in grid.last_values(df, ["k"], "ts", ["id"], ["value"]).collect()}
    assert got == {(k, tick): inside[-1][3] for k, tick, _, inside in ticks_of(samples, 15, 300)}


def test_utilization_of_cores_sampled_apart(spark):
    cpu = [("i", c, "idle", START + 15 * k + shift, k, 15 * k * share) for c, shift, share in (("0", 1.0, 0.2), ("1", 8.0, 0.6)) for k in range(100)]
    cpu += [("i", "0", "user", START + 1.0, 0, 99.0)]
    memory = [("i", START + 40.0 * k, k, 25.0 if k % 2 else None, 100.0) for k in range(10)]
    busy, used = metrics.utilization(
        timed(spark, cpu, "instance string, core string, mode string, t double, tie long, value double"),
        timed(spark, memory, "instance string, t double, tie long, available double, total double"),
    )
    middle = [r.cpu_utilization for r in busy.collect() if START + 400 <= r.tick <= START + 1400]
    assert middle and all(abs(v - 0.6) < 1e-9 for v in middle)
    by_tick = {r.tick: r.memory_utilization for r in used.collect()}
    assert by_tick[START] is None and by_tick[START + 60] == 0.75 and START + 659 not in by_tick


def runs(values, rule, step=15):
    """(key, tick, since) while a rule fires, tick by tick."""
    out = []
    for key in {k for k, _ in values}:
        since = None
        last = None
        for tick in sorted(t for k, t in values if k == key):
            value = values[key, tick]
            holds = value is not None and (value > rule.limit if rule.above else value < rule.limit)
            since = (since if since is not None and last == tick - step else tick) if holds else None
            last = tick
            if since is not None and tick - since >= rule.minutes * 60:
                out.append((key, tick, since))
    return sorted(out)


def test_rules_fire_after_their_time(spark):
    r, rows = random.Random(9), []
    for key in ("a", "b", "c"):
        t, mood = float(START), 0.0
        for k in range(300):
            t += r.choice([1, 5, 20, 60, 60, 400 if key == "c" else 10])
            mood = r.random() if k % 40 == 0 else mood
            rows.append((key, t, len(rows), mood * 2, r.random() < mood / 20))
    df = timed(spark, rows, "k string, t double, id long, v double, bad boolean")
    cases = {
        monitoring.TASK_DELAY: (lambda i: sum(x[3] * 300 for x in i) / len(i), monitoring.mean_duration(df.withColumn("v", F.col("v") * 300), ["k"], "ts", "v")),
        monitoring.LOW_THROUGHPUT: (lambda i: sum(x[3] * 3e9 for x in i) / 300, monitoring.byte_rate(df.withColumn("v", F.col("v") * 3e9), ["k"], "ts", "v")),
        monitoring.HIGH_ERROR_RATE: (lambda i: sum(x[4] for x in i) / len(i), monitoring.error_ratio(df, ["k"], "ts", F.col("bad"))),
    }
    windows = {(k, tick): inside for k, tick, _, inside in ticks_of(rows, 15, 300)}
    for rule, (value, values) in cases.items():
        got = [(x.service, x.tick, x.active_since) for x in monitoring.firing(values, ["k"], rule).collect()]
        assert sorted(got) == runs({key: value(i) for key, i in windows.items()}, rule) != []


def test_latency_rule(spark):
    rows = [("api", START + 10.0 * k, k, 0.9 if 30 <= k < 120 else 0.01) for k in range(200)]
    df = timed(spark, rows, "k string, t double, id long, v double")
    fired = monitoring.firing(monitoring.latency_p95(df, ["k"], "ts", "v"), ["k"], monitoring.HIGH_LATENCY).collect()
    since = {x.active_since for x in fired}
    assert len(since) == 1 and all(START + 300 <= s <= START + 330 for s in since)
    assert min(x.tick for x in fired) == since.pop() + 300
    assert datetime.fromtimestamp(max(x.tick for x in fired), timezone.utc).timestamp() >= START + 1190
