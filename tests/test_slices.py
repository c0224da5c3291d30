"""Sliced windows equal plain windows, with most rows on one key and one moment."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.operators import metrics, windows
from gleanery.plans import slices


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share a key, many share a timestamp."""
    r = F.col("id")
    return spark.range(3000).select(
        r.alias("n"),
        F.when(r % 3 == 0, F.lit("hot")).when(r % 50 == 1, F.lit(None)).otherwise(F.concat(F.lit("k"), (r % 17).cast("string"))).alias("key"),
        F.timestamp_seconds(F.floor(F.pmod(F.xxhash64(r), F.lit(400))) * 97).alias("ts"),
        F.when(r % 7 > 0, F.pmod(F.xxhash64(r, F.lit(1)), F.lit(100)).cast("double")).alias("value"),
    )


def plain(df):
    w = Window.partitionBy("key").orderBy("ts", "n")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns(
        {
            "s": F.sum("value").over(upto),
            "lo": F.min("value").over(upto),
            "hi": F.max("value").over(upto),
            "prev": F.lag("value").over(w),
            "last": F.last("value", ignorenulls=True).over(before),
            "no": F.row_number().over(w).cast("long"),
        }
    )


def sliced(df):
    return slices.running(
        df,
        ["key"],
        ["ts", "n"],
        {
            "s": slices.Running("sum", F.col("value")),
            "lo": slices.Running("min", F.col("value")),
            "hi": slices.Running("max", F.col("value")),
            "prev": slices.Running("prev", F.col("value")),
            "last": slices.Running("before", F.col("value")),
            "no": slices.Running("sum", F.lit(1)),
        },
    )


def same(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    rows = lambda d: sorted(map(repr, d.select(columns).collect()))
    assert rows(a) == rows(b)


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_running_by_range(skewed, parts):
    same(sliced(slices.by_range(skewed, ["key"], ["ts", "n"], parts)), plain(skewed))


def test_no_slice_is_larger_than_a_partition(spark):
    """One key with all rows in one second is still cut into even slices."""
    rows = spark.range(20_000).select(F.lit("hot").alias("key"), F.timestamp_micros(F.col("id")).alias("ts"), "id")
    cut = slices.by_range(rows, ["key"], ["ts", "id"], 20).groupBy("key", slices.SLICE).count().collect()
    assert len(cut) == 20 and max(r["count"] for r in cut) < 3 * 1000


@pytest.mark.parametrize("width", [1, 97, 500, 10**6])
def test_trailing_equals_a_range_frame(skewed, width):
    per_second = skewed.groupBy("key", F.unix_seconds("ts").alias("second")).agg(F.sum("value").alias("v"))
    frame = Window.partitionBy("key").orderBy("second").rangeBetween(-(width - 1), 0)
    want = per_second.select("key", "second", *[f("v").over(frame).alias(n) for n, f in (("s", F.sum), ("lo", F.min), ("hi", F.max))])
    got = slices.trailing(per_second, ["key"], "second", width, {"s": ("sum", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("v"))})
    same(got, want)


def test_trailing_moves_each_row_twice(spark):
    """Windows are formed where the rows went first; nothing is sent a second time."""
    rows = spark.range(100).select(F.lit("k").alias("key"), F.col("id").alias("second"), F.col("id").alias("v"))
    plan = slices.trailing(rows, ["key"], "second", 7, {"s": ("sum", F.col("v"))})._jdf.queryExecution().sparkPlan().toString()
    executed = slices.trailing(rows, ["key"], "second", 7, {"s": ("sum", F.col("v"))})._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and executed.count("Exchange hashpartitioning") == 1


def test_number_all_is_the_global_order(skewed):
    rows = slices.number_all(skewed, ["ts", "n"]).collect()
    ordered = sorted(rows, key=lambda r: (r.ts, r.n))
    assert [r.row_no for r in ordered] == list(range(1, len(rows) + 1))


@pytest.mark.parametrize("size, batches, last", [(50, 3, 50), (40, 4, 30), (1000, 1, 150)])
def test_batch_rows(spark, size, batches, last):
    got = windows.batch_rows(spark.range(150), ["id"], size).groupBy("batch").agg(F.count("*").alias("n"), F.min("id").alias("lo")).orderBy("batch").collect()
    assert len(got) == batches and got[-1].n == last
    assert [r.lo for r in got] == [i * size for i in range(batches)]


def test_batch_size_must_be_positive(spark):
    with pytest.raises(ValueError):
        windows.batch_rows(spark.range(3), ["id"], 0)


@pytest.mark.parametrize("q", [0.0, 0.5, 0.95, 1.0])
@pytest.mark.parametrize("accuracy", [5, 100_000])
def test_percentile_exact_even_with_a_coarse_sketch(skewed, q, accuracy):
    got = {r.key: r.percentile for r in metrics.percentile_exact(skewed, "value", q, ["key"], accuracy).collect()}
    values = {}
    for r in skewed.collect():
        if r.value is not None:
            values.setdefault(r.key, []).append(r.value)
    want = {k: sorted(v)[min(int(q * len(v)), len(v) - 1)] for k, v in values.items()}
    assert got == want


def test_counter_reset(spark):
    rows = [("a", i, 10 * i, v) for i, v in enumerate([5.0, 9.0, 2.0, 2.0, 7.0])]
    df = spark.createDataFrame(rows, "s string, id int, t long, v double").withColumn("ts", F.timestamp_seconds("t"))
    got = metrics.increase(df, ["s"], "ts", "id", "v", 21).orderBy("second").collect()
    assert [r.increase for r in got] == [0.0, 4.0, 6.0, 6.0, 7.0]
