"""Nested values, verdicts, sketches and requests on small fixtures."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gleanery.operators import catalog, validation
from gleanery.streaming import jobs


def test_metadata_values_of_every_kind(spark):
    rows = [
        (1, '{"a": {"b": [1, null, {"c": null, "d": [[true, null]]}]}, "t": "x", "n": 1.5, "big": 123456789012345678901234567890}'),
        (2, None),
        (3, "[1]"),
        (4, "null"),
        (5, "{}"),
        (5, '{"x": null}'),
        (None, '{"x": null}'),
        (6, '{"a.b": {"": null}}'),
    ]
    df = spark.createDataFrame(rows, "id int, body string").select("id", F.parse_json("body").alias("metadata"))
    got = {(r.id, r.path, r.kind, r.values) for r in validation.metadata_type_violations(df, "id", "metadata").collect()}
    assert got == {
        (1, "metadata.a.b[]", "VOID", 1), (1, "metadata.a.b[].c", "VOID", 1), (1, "metadata.a.b[].d[][]", "VOID", 1),
        (3, "metadata", "ARRAY", 1), (4, "metadata", "VOID", 1), (5, "metadata.x", "VOID", 1), (None, "metadata.x", "VOID", 1),
        (6, "metadata.a.b.", "VOID", 1),
    }
    typed = spark.sql("SELECT 1 AS id, to_variant_object(named_struct('d', DATE '2024-01-01', 'b', X'00', 't', TIMESTAMP '2024-01-01 00:00:00', 'f', 1.0D)) AS metadata")
    assert {(r.path, r.kind) for r in validation.metadata_type_violations(typed, "id", "metadata").collect()} == {("metadata.d", "DATE"), ("metadata.b", "BINARY")}
    assert validation.metadata_type_violations(df.limit(0), "id", "metadata").collect() == []


def test_deep_metadata_and_the_session_are_left_alone(spark):
    depth = 60
    body = '{"k":' * depth + "null" + "}" * depth
    df = spark.createDataFrame([(1, body)], "id int, body string").select("id", F.parse_json("body").alias("m"))
    (row,) = validation.metadata_type_violations(df, "id", "m").collect()
    assert row.path == "m" + ".k" * depth
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == "1000000"


def test_split_valid_runs_its_input_once(spark, tmp_path):
    runs = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            runs.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame([(1, "a"), (2, None), (None, "c")], "n int, `__x y` string").mapInArrow(seen, "n int, `__x y` string")
    accepted, quarantine = validation.split_valid(df, [("no_n", F.col("n").isNull()), ("no_text", F.col("`__x y`").isNull())])
    assert [tuple(r) for r in accepted.collect()] == [(1, "a")]
    assert sorted((r.error, r.details) for r in quarantine.collect()) == [("no_n", ["no_n"]), ("no_text", ["no_text"])]
    assert accepted.columns == ["n", "__x y"] and runs.value == 3


def test_repeated_cached_metadata_does_not_multiply_objects(spark):
    objects = spark.sql("SELECT * FROM VALUES (1, map('a', 'x')), (2, CAST(NULL AS MAP<STRING, STRING>)), (3, map('a', 'z')) AS t(id, metadata)")
    cached = spark.sql("SELECT * FROM VALUES (1, map('a', 'new'), 2), (1, map('a', 'old'), 1), (2, map('b', 'y'), 1), (2, NULL, 0), (9, map('c', 'n'), 1) AS t(id, metadata, at)")
    got = {r.id: r.metadata for r in catalog.overlay_metadata(objects, cached, order="at").collect()}
    assert got == {1: {"a": "new"}, 2: {"b": "y"}, 3: {"a": "z"}}
    assert catalog.overlay_metadata(objects, cached).count() == 3


def test_the_first_request_in_time_counts(spark):
    tasks = spark.createDataFrame([(1, "pending", None), (2, "pending", None)], "id int, status string, updated_at timestamp")
    updates = spark.createDataFrame([(1, "running", 1), (1, "cancelled", 2), (2, "completed", 1), (2, "cancelled", 2), (3, "running", 1), (1, None, 0)], "id int, wanted string, seq int")
    state, rejected = catalog.apply_status(tasks, updates, datetime(2024, 1, 1))
    assert {r.id: r.status for r in state.collect()} == {1: "running", 2: "pending"}
    assert {(r.id, r.wanted, r.current, r.allowed) for r in rejected.collect()} == {(2, "completed", "pending", "running,cancelled"), (3, "running", None, None)}


@pytest.mark.parametrize("n, slack", [(1000, 0.0), (60_000, 0.005)])
def test_p95_of_sliding_windows_by_merged_sketches(spark, n, slack):
    """Exact while a window fits the sketch, and within half a percent of the ranks beyond."""
    r = random.Random(n)
    rows = [(k % 900, r.lognormvariate(0, 1), "hot" if k % 3 else "x") for k in range(n)] + [(5, None, "none")]
    df = spark.createDataFrame(rows, "t int, seconds double, k string").withColumn("ts", F.timestamp_seconds(F.col("t") + 1_700_000_100))
    got = jobs.stream_rates(df, ["k"], "seconds", F.lit(False), width=300, slide=60).collect()
    assert len(got) == 2 * (15 + 4) + 5
    for w in got:
        start = int(w.window.start.timestamp()) - 1_700_000_100
        inside = sorted(v for t, v, k in rows if k == w.k and start <= t < start + 300 and v is not None)
        if not inside:
            assert w.p95_seconds is None and w.events == 1
            continue
        assert w.events == len(inside)
        low, high = (inside[min(len(inside) - 1, max(0, int(-(-q * len(inside) // 1)) - 1))] for q in (0.95 - slack, 0.95 + slack))
        assert low <= w.p95_seconds <= high
