"""What the physical plans must and must not hold."""

import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.functions import text as tx
from gleanery.operators import catalog, integrity, metrics, validation
from gleanery.plans import slices
from gleanery.queries import all_queries
from gleanery.sources import writers


def plan(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


# Their calls write files or checkpoint; the plan read back says nothing.
WRITES = {n for n in all_queries() if n.startswith(("a0", "h05_route_stream", "f09_batch"))}


# Windows over one row per partition or slice, or over one page of limited rows.
SMALL_WINDOWS = {"g04_page_keyset", "g03_page_offset", "g03_page_past_end", "e09_percentile_exact_all"}


def ordered_in_one_task(text):
    """Whether a window gets all rows of a plan in one task."""
    since = None
    for line in text.splitlines():
        node = line.lstrip(" :+-*()0123456789")
        if node.startswith("Window "):
            since = node
        elif node.startswith("Exchange"):
            if since and "SinglePartition" in node:
                return since
            since = None
    return None


@pytest.mark.parametrize("name", sorted(set(all_queries()) - WRITES))
def test_no_query_multiplies_rows_or_orders_in_one_task(name, spark, sf):
    text = plan(all_queries()[name](spark, sf))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text
    if name not in SMALL_WINDOWS:
        assert ordered_in_one_task(text) is None


def test_a_window_without_a_key_is_found(spark):
    rows = spark.range(100).withColumn("k", F.col("id") % 3)
    keyed, whole = Window.partitionBy("k").orderBy("id"), Window.orderBy("id")
    assert ordered_in_one_task(plan(rows.withColumn("n", F.row_number().over(keyed)))) is None
    assert "row_number" in ordered_in_one_task(plan(rows.withColumn("n", F.row_number().over(whole))))
    assert "row_number" in ordered_in_one_task(plan(rows.withColumn("n", F.row_number().over(whole)).groupBy("k").agg(F.sum("n"))))


def test_filters_and_columns_reach_the_scan(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").withColumnsRenamed({"o_orderstatus": "status", "o_orderkey": "id"})
    text = plan(catalog.filter_eq(orders, {"status": "P"}).select("id"))
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,P)]" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in text


def test_month_table_is_pruned(spark, tmp_path):
    rows = spark.range(10).select("id", F.timestamp_seconds(F.col("id") * 86400 * 20).alias("ts"))
    writers.write_by_month(rows, str(tmp_path / "m"), "ts")
    month = writers.read_month(spark, str(tmp_path / "m"), "197002")
    assert month.count() == 1
    scanned = re.search(r"PartitionFilters: \[([^\]]*)", plan(month)).group(1)
    assert "partition_key" in scanned


def test_listing_is_a_top_k(spark, sf):
    from gleanery.queries.views import tasks

    assert "TakeOrderedAndProject" in plan(catalog.list_by_status(tasks(spark, sf), "pending"))


def test_dedupe_aggregates_before_the_shuffle(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    text = plan(integrity.dedupe_first(docs, [F.col("text")], ["doc_id"]))
    assert "partial_min_by" in text and "Window" not in text and text.count("Exchange") == 1


def test_cleaning_has_one_arrow_step_and_no_row_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = plan(docs.select(tx.clean_text(F.col("text")).alias("c")))
    assert text.count("ArrowEvalPython") == 1 and "BatchEvalPython" not in text and "Exchange" not in text


def test_masking_stays_in_the_jvm(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = plan(docs.select(tx.mask_text(tx.redact_pii(F.col("text"))).alias("m")))
    assert "Python" not in text and "Exchange" not in text


def test_rules_are_one_pass(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = plan(validation.rule_counts(docs, [("a", F.length("text") > 5), ("b", F.length("lang") > 5)]))
    assert text.count("Scan parquet") == 1 and text.count("Exchange") == 1


def test_histogram_does_not_lay_out_rows_per_bound(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    text = plan(metrics.duration_quantile(events, "value", (1, 10, 100), 0.95, ["event_type"]))
    assert text.count("Exchange") == 1 and "Generate" not in text and "Window" not in text


def test_numbering_needs_no_join(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    numbered = slices.number_rows(slices.by_range(events, ["user_id"], ["ts", "event_id"]), ["user_id"], ["ts", "event_id"])
    text = plan(numbered)
    assert "Join" not in text
    assert re.search(r"Window \[.*user_id#\d+L, __slice", text)


def test_candidates_of_a_percentile_are_not_ordered_in_one_task(spark, sf):
    """Without groups, only one summary row per slice may meet in a single partition."""
    text = plan(all_queries()["e09_percentile_exact_all"](spark, sf))
    for window in re.findall(r"Window \[.*", text):
        assert "__slice" in window, window
