"""The given tables in the roles the operators expect, in Spark and in SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.values import moment
from gleanery.plans.spread import spread
from gleanery.session import configure

NOW = datetime(2001, 11, 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for per-row work on long texts."""
    return spread(table(spark, sf_dir, name))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tasks."""
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM")
    status = (
        F.when(F.col("o_orderstatus") == "P", F.lit("pending"))
        .when(F.col("o_orderstatus") == "O", F.lit("running"))
        .otherwise(F.lit("failed"))
    )
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(urgent, F.lit("scrape")).otherwise(F.lit("ocr")).alias("type"),
        status.alias("status"),
        F.col("o_custkey").alias("owner"),
        F.col("o_totalprice").alias("cost"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.col("o_orderpriority").alias("priority"),
    )


TASKS = """tasks AS (
  SELECT o_orderkey AS id,
         CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH','3-MEDIUM') THEN 'scrape' ELSE 'ocr' END AS type,
         CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
         o_custkey AS owner, o_totalprice AS cost, o_orderdate AS created_at, o_orderpriority AS priority
  FROM orders)"""


def executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as task executions of 10 to 500 seconds; returned ones failed."""
    failed = F.col("l_returnflag") == "R"
    running = (F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "O")
    status = F.when(failed, F.lit("failed")).when(running, F.lit("running")).otherwise(F.lit("completed"))
    start = F.col("l_shipdate").cast("timestamp")
    seconds = (F.col("l_quantity") * 10).cast("long")
    return (
        table(spark, sf_dir, "lineitem")
        .select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format(start, "yyyyMMdd")).alias("id"),
            F.col("l_orderkey").alias("task_id"),
            F.col("l_suppkey").alias("worker_id"),
            status.alias("status"),
            start.alias("start_time"),
            seconds.alias("seconds"),
            (F.col("l_tax") * 100).alias("memory"),
            (F.lit(1.0) - F.col("l_discount")).alias("quality"),
        )
        .withColumns(
            {
                "end_time": F.when(F.col("status") != "running", F.timestamp_seconds(F.unix_seconds("start_time") + F.col("seconds"))),
                "result": F.when(F.col("status") == "completed", F.col("id")),
                "error_message": F.when(F.col("status") == "failed", F.concat(F.lit("returned after "), F.col("seconds").cast("string"))),
            }
        )
    )


EXECUTIONS = """executions AS (
  SELECT *, CASE WHEN status <> 'running' THEN start_time + to_seconds(seconds) END AS end_time,
         CASE WHEN status = 'completed' THEN id END AS result,
         CASE WHEN status = 'failed' THEN 'returned after ' || seconds END AS error_message
  FROM (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')) AS id,
               l_orderkey AS task_id, l_suppkey AS worker_id,
               CASE WHEN l_returnflag = 'R' THEN 'failed'
                    WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'running' ELSE 'completed' END AS status,
               l_shipdate AS start_time, CAST(l_quantity * 10 AS BIGINT) AS seconds,
               l_tax * 100 AS memory, 1.0 - l_discount AS quality
        FROM lineitem))"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a request log: client, endpoint, seconds taken, failed or not."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"),
        F.col("user_id").alias("client"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("endpoint"),
        (F.col("value") / 100).alias("seconds"),
        (F.col("event_type") == "error").alias("failed"),
        F.col("props"),
    )


REQUESTS = """requests AS (
  SELECT event_id AS request_id, user_id AS client, ts, event_type AS endpoint, value / 100 AS seconds,
         event_type = 'error' AS failed, props, CAST(floor(epoch(ts)) AS BIGINT) AS second
  FROM events)"""


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as stored objects of the execution with the same number."""
    kind = (
        F.when(F.col("lang") == "en", F.lit("raw"))
        .when(F.col("lang") == "fr", F.lit("documents"))
        .when(F.col("lang") == "de", F.lit("ocr"))
        .otherwise(F.lit("logs"))
    )
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("execution_id"),
        F.concat(F.lit("gs://data-"), F.col("lang"), F.lit("/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("storage_path"),
        F.concat(F.lit("text/"), F.col("lang")).alias("content_type"),
        kind.alias("class"),
        F.col("n_chars").alias("size_bytes"),
        F.timestamp_seconds(F.unix_seconds(moment(datetime(2000, 10, 25))) + F.col("n_chars") * 3600).alias("created_at"),
        F.col("text"),
    )


OBJECTS = """objects AS (
  SELECT doc_id AS id, source AS execution_id, 'gs://data-' || lang || '/' || source || '/' || doc_id AS storage_path,
         'text/' || lang AS content_type,
         CASE lang WHEN 'en' THEN 'raw' WHEN 'fr' THEN 'documents' WHEN 'de' THEN 'ocr' ELSE 'logs' END AS class,
         n_chars AS size_bytes, TIMESTAMP '2000-10-25' + to_hours(n_chars) AS created_at, text
  FROM documents)"""


def time_text(column) -> Column:
    """Timestamps leave queries as text, the same in every engine."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def sql_time(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


def rule_counts_sql(source: str, rules: list[tuple[str, str]]) -> str:
    """SQL twin of ``validation.rule_counts``."""
    counts = ",\n".join(f"count(*) FILTER (WHERE {bad}) AS \"{name}\"" for name, bad in rules)
    names = ", ".join(f'"{name}"' for name, _ in rules)
    return f"SELECT rule, CAST(bad_rows AS BIGINT) AS bad_rows FROM (SELECT {counts} FROM {source}) UNPIVOT (bad_rows FOR rule IN ({names}))"
