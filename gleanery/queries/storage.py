"""Sources and sinks (A): write to a fresh shared folder, read back.

The folder lies below the configured checkpoint folder; these queries run their
writes when called.
"""

from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.queries import query
from gleanery.queries.cleaning import mask_sql
from gleanery.queries.views import EXECUTIONS, TASKS, executions, table, tasks, time_text
from gleanery.session import configure, scratch_path
from gleanery.sources import readers, writers
from gleanery.streaming import jobs, routing

_DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@query(
    "a01_read_landing_json",
    """SELECT doc_id, source, n_chars, CAST(NULL AS VARCHAR) AS corrupt FROM documents WHERE lang <> 'de'
       UNION ALL SELECT NULL, NULL, NULL, '{"doc_id": ' || doc_id || ', "source": ' FROM documents WHERE lang = 'de'""",
)
def read_landing_json(spark, sf):
    docs = table(spark, sf, "documents")
    line = F.when(
        F.col("lang") == "de", F.concat(F.lit('{"doc_id": '), F.col("doc_id").cast("string"), F.lit(', "source": '))
    ).otherwise(F.to_json(F.struct("doc_id", "source", "n_chars")))
    path = scratch_path(spark, "landing")
    docs.select(line.alias("value")).write.text(path)
    return readers.read_landing(spark, path, "json", _DOC).withColumnRenamed(readers.CORRUPT, "corrupt")


@query("a01_read_landing_csv", "SELECT doc_id, source, n_chars, CAST(NULL AS VARCHAR) AS corrupt FROM documents")
def read_landing_csv(spark, sf):
    path = scratch_path(spark, "landing")
    table(spark, sf, "documents").select("doc_id", "source", "n_chars").write.option("header", True).csv(path)
    return readers.read_landing(spark, path, "csv", _DOC).withColumnRenamed(readers.CORRUPT, "corrupt")


@query("a01_read_landing_parquet", "SELECT doc_id, source, n_chars FROM documents")
def read_landing_parquet(spark, sf):
    configure(spark)
    return readers.read_landing(spark, f"{sf}/documents.parquet", "parquet", _DOC)


# Names with a leading underscore, a space, a percent sign and letters beyond ASCII; some objects are empty.
_NAME = "lang || '/' || CASE doc_id % 3 WHEN 0 THEN '_' WHEN 1 THEN 'é ' ELSE '%41' END || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.TXT' ELSE '.json' END"
_BODY = "CASE WHEN doc_id % 5 = 0 THEN '' ELSE source END"


def _named_objects(spark, sf):
    path = scratch_path(spark, "listing")
    named = table(spark, sf, "documents").select(F.expr(_NAME).alias("name"), F.expr(_BODY).alias("body"), F.create_map(F.lit("lang"), F.col("lang")).alias("meta"))
    writers.write_with_sidecar(named, path, "name", "body", "meta")
    return path


@query(
    "a02_list_objects",
    f"""SELECT name, octet_length(encode(body)) AS size_bytes, '.txt' AS content_suffix
        FROM (SELECT {_NAME} AS name, {_BODY} AS body FROM documents WHERE doc_id % 2 = 0)""",
)
def list_objects(spark, sf):
    return readers.list_objects(spark, _named_objects(spark, sf), suffixes=[".TXT"]).drop("modified_at")


@query(
    "a02_list_prefix",
    f"""WITH o AS (SELECT {_NAME} AS name, {_BODY} AS body, lang FROM documents WHERE lang = 'fr')
        SELECT name, octet_length(encode(body)) AS size_bytes FROM o WHERE starts_with(name, 'fr/_')
        UNION ALL SELECT name || '.meta', octet_length(encode('{{"lang":"' || lang || '"}}')) FROM o WHERE starts_with(name, 'fr/_')""",
)
def list_prefix(spark, sf):
    return readers.list_objects(spark, _named_objects(spark, sf), prefix="fr/_").select("name", "size_bytes")


@query(
    "a03_read_content",
    f"""SELECT {_NAME} AS name, {_BODY} AS body, octet_length(encode({_BODY})) AS size_bytes, lang, 'application/octet-stream' AS content_type FROM documents""",
)
def read_content(spark, sf):
    back = readers.read_with_sidecar(spark, _named_objects(spark, sf), content=True)
    return back.select("name", F.col("content").cast("string").alias("body"), "size_bytes", F.col("metadata")["lang"].alias("lang"), "content_type")


@query(
    "a03_read_with_sidecar",
    """SELECT page_id || '.html' AS name, octet_length(encode(html)) AS size_bytes, url,
              CASE WHEN starts_with(url, 'https') THEN 'text/html' ELSE 'application/octet-stream' END AS content_type FROM pages""",
)
def read_with_sidecar(spark, sf):
    secure = F.col("url").startswith("https")
    meta = F.create_map(F.lit("url"), F.col("url"), F.when(secure, F.lit("content_type")).otherwise(F.lit("note")), F.lit("text/html"))
    pages = table(spark, sf, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("name"), "html", meta.alias("meta"))
    path = scratch_path(spark, "objects")
    writers.write_with_sidecar(pages, path, "name", "html", "meta")
    back = readers.read_with_sidecar(spark, path)
    return back.select("name", "size_bytes", F.col("metadata")["url"].alias("url"), "content_type")


@query("a04_write_objects", "SELECT event_id, strftime(ts, '%Y/%m/%d') AS day FROM events")
def write_objects(spark, sf):
    path = scratch_path(spark, "dated")
    # Rows of a day meet before the write: one file per day folder.
    events = table(spark, sf, "events").select("event_id", "ts")
    writers.write_objects(events.repartition(F.date_format("ts", "yyyyMMdd")), path, "ts")
    back = spark.read.schema("event_id long, y string, m string, d string").parquet(path)
    return back.select("event_id", F.concat_ws("/", "y", "m", "d").alias("day"))


@query("a05_write_by_month", "SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y%m') = '199703'")
def write_by_month(spark, sf):
    path = scratch_path(spark, "monthly")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    writers.write_by_month(orders.repartition(F.date_format("o_orderdate", "yyyyMM")), path, "o_orderdate")
    return writers.read_month(spark, path, "199703").select("o_orderkey")


@query(
    "a06_store_results",
    """SELECT sha256('text|' || doc_id) AS id, 'text/plain' AS content_type, 'text' AS pipeline_type, '2001/11/01/' || sha256('text|' || doc_id) AS path_tail FROM documents""",
)
def store_results(spark, sf):
    path, manifest = scratch_path(spark, "content"), scratch_path(spark, "manifest")
    docs = table(spark, sf, "documents").select("doc_id", "text", F.lit("text").alias("kind"))
    writers.store_results(docs, path, manifest, "doc_id", "kind", datetime(2001, 11, 1))
    tail = F.substring_index("storage_path", "/", -4)
    return spark.read.parquet(manifest).select("id", "content_type", "pipeline_type", tail.alias("path_tail"))


@query("a07_export_listing", f"WITH {TASKS} SELECT id, type, status, strftime(created_at, '%Y-%m-%d') AS day FROM tasks")
def export_listing(spark, sf):
    path = scratch_path(spark, "export")
    writers.export_listing(tasks(spark, sf), "csv", path)
    back = spark.read.option("header", True).schema("id long, type string, status string, created_at timestamp").csv(path)
    return back.select("id", "type", "status", F.date_format("created_at", "yyyy-MM-dd").alias("day"))


@query("a07_export_listing_json", f"WITH {TASKS} SELECT id, type, status, strftime(created_at, '%Y-%m-%d') AS day FROM tasks")
def export_listing_json(spark, sf):
    path = scratch_path(spark, "export")
    writers.export_listing(tasks(spark, sf), "json", path)
    back = spark.read.schema("id long, type string, status string, created_at timestamp").json(path)
    return back.select("id", "type", "status", F.date_format("created_at", "yyyy-MM-dd").alias("day"))


def _messages(spark, sf):
    """Failed executions as queue messages."""
    e = executions(spark, sf).filter(F.col("status") == "failed")
    return e.select(
        F.col("id").alias("task_id"),
        F.lit("scrape").alias("task_type"),
        F.col("start_time").alias("scheduled_at"),
        F.when(F.col("memory") > 6.5, F.lit("cancel")).otherwise(F.lit("execute")).alias("operation"),
        F.floor(F.col("seconds") / 100).cast("int").alias("retry_count"),
        F.col("error_message").alias("error"),
    )


_MESSAGES = """messages AS (SELECT id AS task_id, start_time AS scheduled_at, CASE WHEN memory > 6.5 THEN 'cancel' ELSE 'execute' END AS operation,
      CAST(floor(seconds / 100) AS INTEGER) AS retry_count, error_message AS error FROM executions WHERE status = 'failed')"""


@query(
    "a08_read_task_stream",
    f"WITH {EXECUTIONS}, {_MESSAGES} SELECT task_id, operation, retry_count, strftime(scheduled_at, '%Y-%m-%d') AS day FROM messages",
)
def read_task_stream(spark, sf):
    queue, out, state = (scratch_path(spark, n) for n in ("queue", "received", "state"))
    _messages(spark, sf).write.json(queue)
    stream = readers.read_task_stream(spark, queue)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("task_id", "operation", "retry_count", F.date_format("scheduled_at", "yyyy-MM-dd").alias("day"))


_ROUTE = """routed AS (SELECT task_id, CASE WHEN operation = 'cancel' THEN 'cancel' WHEN retry_count < 3 THEN 'retry' ELSE 'dead_letter' END AS route,
      retry_count, scheduled_at, error FROM messages)"""


@query(
    "h05_route_failures",
    f"""WITH {EXECUTIONS}, {_MESSAGES}, {_ROUTE} SELECT task_id, route, CAST(CASE route WHEN 'retry' THEN retry_count + 1 ELSE retry_count END AS INTEGER) AS retry_count,
          CASE route WHEN 'retry' THEN strftime(scheduled_at + to_seconds(60 * CAST(pow(2, retry_count) AS BIGINT)), '%Y-%m-%d %H:%M:%S') END AS due FROM routed""",
)
def route_failures(spark, sf):
    routed = routing.route_failures(_messages(spark, sf).withColumn("failed_at", F.col("scheduled_at")), F.col("failed_at"))
    return routed.select("task_id", "route", "retry_count", time_text("scheduled_at").alias("due"))


@query(
    "h05_route_stream",
    f"""WITH {EXECUTIONS}, {_MESSAGES}, {_ROUTE} SELECT task_id, route, CAST(CASE route WHEN 'retry' THEN retry_count + 1 ELSE retry_count END AS INTEGER) AS retry_count
        FROM routed""",
)
def route_stream(spark, sf):
    queue, routes, state = (scratch_path(spark, n) for n in ("queue", "routes", "state"))
    _messages(spark, sf).write.json(queue)
    failed = readers.read_task_stream(spark, queue).withColumn("failed_at", F.col("scheduled_at"))
    routing.write_routes(failed, routes, state).awaitTermination()
    return spark.read.schema("task_id string, retry_count int, batch_id long, route string").json(routes).drop("batch_id")


@query("a09_write_log_stream", f"SELECT doc_id, {mask_sql('text')} AS message FROM documents")
def write_log_stream(spark, sf):
    logs, out, state = (scratch_path(spark, n) for n in ("logs", "masked", "state"))
    table(spark, sf, "documents").select("doc_id", F.col("text").alias("message")).write.parquet(logs)
    stream = spark.readStream.schema("doc_id long, message string").parquet(logs)
    writers.write_log_stream(jobs.mask_log_stream(stream), out, state, every=None).awaitTermination()
    return spark.read.schema("doc_id long, message string").json(out)
