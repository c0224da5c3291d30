"""Catalogue lookups, listings, joins, writes, paging (B17-B27, B33-B35, D, F3, G)."""

from datetime import datetime

from pyspark.sql import functions as F

from gleanery.functions.values import moment
from gleanery.operators import alerts, catalog, integrity, metrics
from gleanery.operators.validation import source_rules
from gleanery.queries import query
from gleanery.queries.views import (
    EXECUTIONS,
    NOW,
    OBJECTS,
    TASKS,
    executions,
    objects,
    sql_time,
    table,
    tasks,
    time_text,
)

_NOW = "TIMESTAMP '2001-11-01'"
_CREATED = sql_time("created_at") + " AS created_at"


def _listing(df):
    return df.select("id", "type", "status", time_text("created_at").alias("created_at"))


# --- filters ---------------------------------------------------------------


@query("b17_filter_eq", f"WITH {TASKS} SELECT id, type, status, {_CREATED} FROM tasks WHERE type = 'ocr' AND status = 'pending'")
def filter_eq(spark, sf):
    return _listing(catalog.filter_eq(tasks(spark, sf), {"type": "ocr", "status": "pending"}))


@query("b18_get_by_id", f"WITH {TASKS} SELECT id, type, status, {_CREATED} FROM tasks WHERE id = 77")
def get_by_id(spark, sf):
    return _listing(catalog.get_by_id(tasks(spark, sf), 77))


@query("b18_get_by_name", "SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_name = 'Supplier#000000007'")
def get_by_name(spark, sf):
    sources = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return catalog.get_by_name(sources, "Supplier#000000007")


@query("b19_owned_by", f"WITH {TASKS} SELECT id, type, status, {_CREATED} FROM tasks WHERE owner = 42")
def owned_by(spark, sf):
    return _listing(catalog.owned_by(tasks(spark, sf), 42))


@query("b20_active_of_type", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_acctbal > 0")
def active_of_type(spark, sf):
    sources = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("type"), (F.col("c_acctbal") > 0).alias("is_active")
    )
    return catalog.active_of_type(sources, "MACHINERY").select("id", "name")


@query(
    "b21_allowed_domains",
    r"""SELECT page_id, url FROM pages
        WHERE regexp_matches(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^(.*\.)?(example\.net|spam-farm\.example\.org)$')""",
)
def allowed_domains(spark, sf):
    domains = ["", " Example.NET ", "spam-farm.example.org"]
    return catalog.allowed_domains(table(spark, sf, "pages").select("page_id", "url"), "url", domains)


@query(
    "b22_sample_by_key",
    "SELECT event_id, user_id FROM events WHERE CAST('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 < 0.1",
)
def sample_by_key(spark, sf):
    return catalog.sample_by_key(table(spark, sf, "events").select("event_id", "user_id"), "user_id", 0.1)


@query(
    "b23_search_keys",
    f"WITH {TASKS} SELECT type_status, created_date, count(*) AS n FROM (SELECT type || '_' || status AS type_status, strftime(created_at, '%Y-%m-%d') AS created_date FROM tasks) GROUP BY ALL",
)
def search_keys(spark, sf):
    return catalog.search_keys(tasks(spark, sf)).groupBy("type_status", "created_date").agg(F.count("*").alias("n"))


@query(
    "b24_task_response",
    f"""WITH {TASKS} SELECT id, '{{"id":"' || id || '","type":"' || type || '"' ||
          CASE WHEN status <> 'failed' THEN ',"status":"' || status || '"' ELSE '' END ||
          ',"created_at":"' || strftime(created_at, '%Y-%m-%dT%H:%M:%S') || '","links":{{"self":"/api/v1/tasks/' || id ||
          '","status":"/api/v1/tasks/' || id || '/status"}}}}' AS body FROM tasks""",
)
def task_response(spark, sf):
    t = tasks(spark, sf).select("id", "type", F.nullif(F.col("status"), F.lit("failed")).alias("status"), "created_at")
    return catalog.task_response(t)


@query(
    "b25_storage_paths",
    f"""WITH {OBJECTS} SELECT id, 'gs://bucket/executions/' || execution_id || '/' || id AS execution_path,
          '/documents/' || strftime(created_at, '%Y/%m') || '/' || id AS document_path,
          '/ocr_results/' || id || '/' || strftime(created_at, '%Y%m%d%H%M%S') AS ocr_path,
          strftime(created_at, '%Y/%m/%d') || '/' || id AS dated_path,
          '/logs/' || strftime(created_at, '%Y-%m-%d') AS log_date_path FROM objects""",
)
def storage_paths(spark, sf):
    paths = catalog.storage_paths(objects(spark, sf), "bucket", "execution_id", "id", "created_at")
    return paths.select("id", "execution_path", "document_path", "ocr_path", "dated_path", "log_date_path")


@query(
    "b26_enrich_metadata",
    f"WITH {OBJECTS} SELECT id, content_type, CAST(size_bytes AS VARCHAR) AS size, 'kept' AS note FROM objects",
)
def enrich_metadata(spark, sf):
    given = F.create_map(F.lit("content_type"), F.lit("unknown"), F.lit("note"), F.lit("kept"))
    o = objects(spark, sf).withColumn("metadata", given)
    m = catalog.enrich_metadata(o, "metadata", content_type=F.col("content_type"), size_bytes=F.col("size_bytes"))
    return m.select("id", *[F.col("metadata")[k].alias(a) for k, a in (("content_type", "content_type"), ("size_bytes", "size"), ("note", "note"))])


@query("b27_size_limit", f"WITH {OBJECTS} SELECT id, size_bytes FROM objects WHERE size_bytes <= 5000")
def size_limit(spark, sf):
    return catalog.size_limit(objects(spark, sf), "size_bytes", 5000).select("id", "size_bytes")


@query(
    "b33_drop_metrics",
    "SELECT metric, count(*) AS n FROM (SELECT CASE event_type WHEN 'view' THEN 'go_threads' ELSE 'app_go_' || event_type END AS metric FROM events) WHERE metric NOT LIKE 'go\\_%' ESCAPE '\\' GROUP BY metric",
)
def drop_metrics(spark, sf):
    name = F.when(F.col("event_type") == "view", F.lit("go_threads")).otherwise(F.concat(F.lit("app_go_"), F.col("event_type")))
    series = table(spark, sf, "events").select(name.alias("metric"))
    return metrics.drop_metrics(series).groupBy("metric").agg(F.count("*").alias("n"))


@query(
    "b34_filter_logs",
    """SELECT event_id, props AS message FROM events
       WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-10' AND ts >= TIMESTAMP '2024-04-15' - INTERVAL 90 DAYS AND contains(props, '7')""",
)
def filter_logs(spark, sf):
    logs = table(spark, sf, "events").select("event_id", F.col("event_type").alias("level"), F.col("ts").cast("timestamp").alias("ts"), F.col("props").alias("message"))
    found = catalog.filter_logs(logs, "error", datetime(2024, 1, 10), "7", datetime(2024, 4, 15))
    return found.select("event_id", "message")


def _sources(spark, sf):
    """Suppliers as sources: below nation 12 a scrape source."""
    scrape = F.col("s_nationkey") < 12
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"),
        F.col("s_name").alias("name"),
        F.when(scrape, F.lit("scrape")).otherwise(F.lit("ocr")).alias("type"),
        F.create_map(F.when(scrape, F.lit("api_key")).otherwise(F.lit("service_account")), F.lit("x")).alias("credentials"),
        F.create_map(F.when(scrape, F.lit("base_url")).otherwise(F.lit("output_format")), F.lit("old")).alias("configuration"),
        F.create_map(F.lit("content_type"), F.lit("text/html")).alias("metadata"),
        moment(datetime(2000, 1, 1)).alias("updated_at"),
        F.col("s_acctbal").alias("balance"),
    )


@query(
    "b35_merge_config",
    """SELECT s_suppkey AS id, CASE WHEN s_acctbal > 0 AND s_nationkey < 12 THEN 'new' WHEN s_nationkey < 12 THEN 'old' END AS base_url,
              CASE WHEN s_acctbal > 5000 THEN '2001-11-01 00:00:00' WHEN s_acctbal > 0 AND s_nationkey < 12 THEN '2001-11-01 00:00:00'
                   ELSE '2000-01-01 00:00:00' END AS updated_at,
              CASE WHEN s_acctbal > 0 AND s_nationkey >= 12 AND s_acctbal <= 5000 THEN 'configuration' WHEN s_acctbal > 0 THEN '' END AS errors
       FROM supplier""",
)
def merge_config(spark, sf):
    s = _sources(spark, sf)
    # Below 5000 the changes void an OCR source's output format.
    broken = (F.col("type") == "ocr") & (F.col("balance") <= 5000)
    changes = F.create_map(F.when(F.col("type") == "scrape", F.lit("base_url")).otherwise(F.lit("note")), F.lit("new"))
    updates = s.filter(F.col("balance") > 0).select("id", changes.alias("changes"), broken.alias("broken"))
    rules = source_rules(F.col("name"), F.col("type"), F.col("credentials"), F.col("configuration"), F.col("metadata"))
    rules = [
        (n, bad | (F.map_contains_key("configuration", F.lit("note")) & (F.col("balance") <= 5000)) if n == "configuration" else bad)
        for n, bad in rules
    ]
    merged = catalog.merge_config(s, updates, rules, NOW)
    return merged.select("id", F.col("configuration")["base_url"].alias("base_url"), time_text("updated_at").alias("updated_at"), F.array_join("errors", ",").alias("errors"))


# --- joins -----------------------------------------------------------------


_KEY = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d'))"


@query(
    "d01_lineage",
    f"""SELECT c_custkey AS source_id, c_name AS source_name, o_orderkey AS task_id, o_orderstatus AS task_status,
              e.id AS execution_id, e.status AS execution_status, o.id AS object_id, o.path AS storage_path
       FROM customer LEFT JOIN orders ON o_custkey = c_custkey
       LEFT JOIN (SELECT {_KEY} AS id, l_orderkey, l_linestatus AS status FROM lineitem) e ON l_orderkey = o_orderkey
       LEFT JOIN (SELECT l_partkey AS id, {_KEY} AS execution_id, p_name AS path FROM lineitem JOIN part ON p_partkey = l_partkey) o
         ON o.execution_id = e.id""",
)
def lineage(spark, sf):
    """Customers, their orders, the items of these, and the part each item stored."""
    sources = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    t = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("source_id"), F.col("o_orderstatus").alias("status"))
    items = table(spark, sf, "lineitem").withColumn(
        "id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd"))
    )
    e = items.select("id", F.col("l_orderkey").alias("task_id"), F.col("l_linestatus").alias("status"))
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("storage_path"))
    stored = items.select(F.col("id").alias("execution_id"), "l_partkey").join(parts, "l_partkey")
    o = stored.select(F.col("l_partkey").alias("id"), "execution_id", "storage_path")
    return catalog.lineage(sources, t, e, o)


@query(
    "d02_with_task_metrics",
    f"WITH {TASKS}, {EXECUTIONS}, m AS (SELECT task_id, max(memory) AS peak, count(*) AS runs, count(*) FILTER (WHERE status = 'failed') AS failed FROM executions GROUP BY task_id) "
    "SELECT id, type, round(peak, 6) AS peak, runs, failed FROM tasks LEFT JOIN m ON task_id = id",
)
def with_task_metrics(spark, sf):
    totals = [F.round(F.max("memory"), 6).alias("peak"), F.count("*").alias("runs"), F.count_if(F.col("status") == "failed").alias("failed")]
    m = executions(spark, sf).groupBy(F.col("task_id").alias("id")).agg(*totals)
    return catalog.with_task_metrics(tasks(spark, sf).select("id", "type"), m)


@query(
    "d03_overlay_metadata",
    """WITH c AS (SELECT doc_id, quality, 0 AS version FROM labels UNION ALL SELECT doc_id, 1 - quality, 1 FROM labels WHERE toxic = 1),
            l AS (SELECT doc_id, arg_max(quality, version) AS quality FROM c GROUP BY doc_id)
       SELECT d.doc_id AS id, d.lang, CAST(l.quality AS VARCHAR) AS quality, CASE WHEN l.doc_id IS NULL THEN d.source ELSE 'labelled' END AS origin
       FROM documents d LEFT JOIN l USING (doc_id)""",
)
def overlay_metadata(spark, sf):
    """Labels as cached metadata; those of toxic documents were cached twice."""
    stored = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.create_map(F.lit("lang"), F.col("lang"), F.lit("origin"), F.col("source")).alias("metadata"))
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic", F.lit(0).alias("version"))
    twice = labels.filter("toxic = 1").select("id", (1 - F.col("quality")).alias("quality"), "toxic", F.lit(1).alias("version"))
    own = F.create_map(F.lit("quality"), F.col("quality").cast("string"), F.lit("origin"), F.lit("labelled"))
    cached = labels.unionByName(twice).select("id", own.alias("metadata"), "version")
    m = catalog.overlay_metadata(stored, cached, order="version")
    return m.select("id", *[F.col("metadata")[k].alias(k) for k in ("lang", "quality", "origin")])


@query(
    "d04_list_by_execution",
    f"WITH {OBJECTS} SELECT id, content_type, size_bytes FROM objects WHERE execution_id = 'src3' AND class = 'raw'",
)
def list_by_execution(spark, sf):
    return catalog.list_by_execution(objects(spark, sf), "src3", {"class": "raw"}).select("id", "content_type", "size_bytes")


def _updates(spark, sf):
    """Expensive tasks set to failed, a third of them under ids that do not exist."""
    t = tasks(spark, sf).filter(F.col("cost") > 400000)
    return t.select(F.when(F.col("priority") == "5-LOW", -F.col("id") - 1).otherwise(F.col("id")).alias("id"), "type", F.lit("updated").alias("status"), "created_at")


_UPDATES = "updates AS (SELECT CASE WHEN priority = '5-LOW' THEN -id - 1 ELSE id END AS id, type, 'updated' AS status, created_at FROM tasks WHERE cost > 400000)"
_T4 = "SELECT id, type, status, created_at"


def _tasks4(spark, sf):
    return tasks(spark, sf).select("id", "type", "status", "created_at")


@query(
    "d05_upsert",
    f"WITH {TASKS}, {_UPDATES} SELECT id, type, status, {_CREATED} FROM ({_T4} FROM tasks WHERE id NOT IN (SELECT id FROM updates) UNION ALL {_T4} FROM updates)",
)
def upsert(spark, sf):
    return _listing(catalog.upsert(_tasks4(spark, sf), _updates(spark, sf)))


@query(
    "d05_update_existing",
    f"WITH {TASKS}, {_UPDATES} SELECT id, type, coalesce(u.status, t.status) AS status, strftime(t.created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM tasks t LEFT JOIN (SELECT id, status FROM updates) u USING (id)",
)
def update_existing(spark, sf):
    return _listing(catalog.update_existing(_tasks4(spark, sf), _updates(spark, sf))[0])


@query(
    "d05_update_missing",
    f"WITH {TASKS}, {_UPDATES} SELECT id, type, status, {_CREATED} FROM updates WHERE id < 0",
)
def update_missing(spark, sf):
    return _listing(catalog.update_existing(_tasks4(spark, sf), _updates(spark, sf))[1])


@query(
    "d05_create_new",
    f"WITH {TASKS}, {_UPDATES} SELECT id, type, status, {_CREATED} FROM ({_T4} FROM tasks UNION ALL {_T4} FROM updates WHERE id < 0)",
)
def create_new(spark, sf):
    return _listing(catalog.create_new(_tasks4(spark, sf), _updates(spark, sf))[0])


@query("d06_delete_rows", f"WITH {TASKS}, {_UPDATES} SELECT id, type, status, {_CREATED} FROM tasks WHERE id NOT IN (SELECT id FROM updates)")
def delete_rows(spark, sf):
    current, gone = _tasks4(spark, sf), _updates(spark, sf)
    return _listing(catalog.delete_rows(catalog.delete_rows(current, gone), gone))


def _ops(spark, sf):
    """One operation per line item: on its order, or on a task that is not there."""
    item = table(spark, sf, "lineitem")
    kind = F.when(F.col("l_returnflag") == "R", F.lit("delete")).when(F.col("l_returnflag") == "A", F.lit("create")).otherwise(F.lit("update"))
    target = F.when(F.col("l_linestatus") == "F", -F.col("l_orderkey") - 1).otherwise(F.col("l_orderkey"))
    # (order, line, part, supplier, date) is unique; its text order stands for time.
    seq = F.col("l_partkey") * 10_000_000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")
    return item.select(kind.alias("op"), seq.alias("seq"), target.alias("id"), F.lit("written").alias("type"), F.col("l_linenumber").cast("string").alias("status"))


@query(
    "a11_apply_writes",
    f"""WITH {TASKS}, ops AS (
          SELECT CASE l_returnflag WHEN 'R' THEN 'delete' WHEN 'A' THEN 'create' ELSE 'update' END AS op,
                 l_partkey * 10000000 + l_suppkey * 10 + l_linenumber AS seq,
                 CASE WHEN l_linestatus = 'F' THEN -l_orderkey - 1 ELSE l_orderkey END AS id, l_linenumber AS line FROM lineitem),
        judged AS (
          SELECT o.*, coalesce(last_value(CASE op WHEN 'create' THEN true WHEN 'delete' THEN false END IGNORE NULLS)
                   OVER (PARTITION BY o.id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), t.id IS NOT NULL) AS here
          FROM ops o LEFT JOIN tasks t ON t.id = o.id),
        legal AS (SELECT * FROM judged WHERE (op = 'create') <> here),
        final AS (SELECT id, arg_max(op, seq) AS op, arg_max(line, seq) AS line FROM legal GROUP BY id)
        SELECT id, type, status FROM tasks WHERE id NOT IN (SELECT id FROM final)
        UNION ALL SELECT id, 'written', CAST(line AS VARCHAR) FROM final WHERE op <> 'delete'""",
)
def apply_writes(spark, sf):
    return catalog.apply_writes(tasks(spark, sf).select("id", "type", "status"), _ops(spark, sf))[0]


@query(
    "a11_apply_writes_rejected",
    f"""WITH {TASKS}, ops AS (
          SELECT CASE l_returnflag WHEN 'R' THEN 'delete' WHEN 'A' THEN 'create' ELSE 'update' END AS op,
                 l_partkey * 10000000 + l_suppkey * 10 + l_linenumber AS seq,
                 CASE WHEN l_linestatus = 'F' THEN -l_orderkey - 1 ELSE l_orderkey END AS id FROM lineitem),
        judged AS (
          SELECT o.*, coalesce(last_value(CASE op WHEN 'create' THEN true WHEN 'delete' THEN false END IGNORE NULLS)
                   OVER (PARTITION BY o.id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), t.id IS NOT NULL) AS here
          FROM ops o LEFT JOIN tasks t ON t.id = o.id)
        SELECT id, op, seq, CASE op WHEN 'create' THEN 'already exists' ELSE 'not found' END AS reason FROM judged WHERE (op = 'create') = here""",
)
def apply_writes_rejected(spark, sf):
    return catalog.apply_writes(tasks(spark, sf).select("id", "type", "status"), _ops(spark, sf))[1].select("id", "op", "seq", "reason")


@query(
    "d07_unique_violations",
    """WITH new AS (SELECT p_name AS name, count(*) AS copies FROM part GROUP BY p_name UNION ALL SELECT s_name, 1 FROM supplier WHERE s_acctbal > 0)
       SELECT name, copies, starts_with(name, 'Supplier#') AS taken FROM new WHERE copies > 1 OR starts_with(name, 'Supplier#')""",
)
def unique_violations(spark, sf):
    suppliers = table(spark, sf, "supplier")
    current = suppliers.select(F.col("s_name").alias("name"))
    new = table(spark, sf, "part").select(F.col("p_name").alias("name")).unionByName(suppliers.filter("s_acctbal > 0").select(F.col("s_name").alias("name")))
    return catalog.unique_violations(current, new, "name")


@query(
    "d08_inhibit",
    """WITH a AS (SELECT event_id, event_type AS alertname, CASE WHEN user_id % 3 > 0 THEN user_id % 3 END AS cluster,
                         strftime(ts, '%Y-%m-%d %H') AS service, CASE WHEN value > 200 THEN 'critical' WHEN value > 20 THEN 'warning' ELSE 'info' END AS severity FROM events)
       SELECT event_id, severity FROM a WHERE severity <> 'warning' OR NOT EXISTS (
         SELECT 1 FROM a c WHERE c.severity = 'critical' AND c.alertname = a.alertname AND c.cluster IS NOT DISTINCT FROM a.cluster AND c.service = a.service)""",
)
def inhibit(spark, sf):
    value, third = F.col("value"), F.col("user_id") % 3
    a = table(spark, sf, "events").select(
        "event_id",
        F.col("event_type").alias("alertname"),
        F.when(third > 0, third).alias("cluster"),
        F.date_format("ts", "yyyy-MM-dd HH").alias("service"),
        F.when(value > 200, F.lit("critical")).when(value > 20, F.lit("warning")).otherwise(F.lit("info")).alias("severity"),
    )
    return alerts.inhibit(a).select("event_id", "severity")


@query(
    "d09_expire",
    f"""WITH {OBJECTS} SELECT id, class, created_at < {_NOW} - to_days(CASE class WHEN 'raw' THEN 90 WHEN 'documents' THEN 365 WHEN 'ocr' THEN 180 ELSE 30 END) AS expired FROM objects""",
)
def expire(spark, sf):
    return catalog.expire(objects(spark, sf), NOW).select("id", "class", "expired")


@query("d10_orphans", "SELECT doc_id, source FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id)")
def orphans(spark, sf):
    child = table(spark, sf, "documents").select("doc_id", "source")
    return catalog.orphans(child, table(spark, sf, "labels"), "doc_id", "doc_id")


def _moves(spark, sf):
    """A request per line item, in the order of the lines; some are for tasks that do not exist."""
    wanted = F.when(F.col("l_returnflag") == "R", F.lit("running")).when(F.col("l_returnflag") == "N", F.lit("pending")).otherwise(F.lit("cancelled"))
    target = F.when(F.col("l_orderkey") % 10 == 0, -F.col("l_orderkey") - 1).otherwise(F.col("l_orderkey"))
    return table(spark, sf, "lineitem").select(target.alias("id"), wanted.alias("wanted"), F.col("l_linenumber").alias("seq"))


_MOVES = """asked AS (SELECT CASE WHEN l_orderkey % 10 = 0 THEN -l_orderkey - 1 ELSE l_orderkey END AS id, l_linenumber AS seq,
     CASE l_returnflag WHEN 'R' THEN 'running' WHEN 'N' THEN 'pending' ELSE 'cancelled' END AS wanted FROM lineitem),
     moves AS (SELECT id, arg_min(wanted, (seq, wanted)) AS wanted FROM asked GROUP BY id)"""
_LEGAL = "((status = 'pending' AND wanted IN ('running', 'cancelled')) OR (status = 'failed' AND wanted = 'pending') OR (status = 'running' AND wanted IN ('completed', 'failed')))"


@query(
    "d11_apply_status",
    f"""WITH {TASKS}, {_MOVES} SELECT id, CASE WHEN {_LEGAL} THEN wanted ELSE status END AS status,
        CASE WHEN {_LEGAL} THEN '2001-11-01 00:00:00' ELSE {sql_time('created_at')} END AS updated_at FROM tasks LEFT JOIN moves USING (id)""",
)
def apply_status(spark, sf):
    t = tasks(spark, sf).select("id", "status", F.col("created_at").alias("updated_at"))
    return catalog.apply_status(t, _moves(spark, sf), NOW)[0].select("id", "status", time_text("updated_at").alias("updated_at"))


@query(
    "d11_apply_status_rejected",
    f"""WITH {TASKS}, {_MOVES} SELECT id, wanted, status AS current,
          CASE status WHEN 'pending' THEN 'running,cancelled' WHEN 'running' THEN 'completed,failed' WHEN 'failed' THEN 'pending' END AS allowed
        FROM moves LEFT JOIN tasks USING (id) WHERE NOT coalesce({_LEGAL}, false)""",
)
def apply_status_rejected(spark, sf):
    t = tasks(spark, sf).select("id", "status", F.col("created_at").alias("updated_at"))
    return catalog.apply_status(t, _moves(spark, sf), NOW)[1]


@query(
    "f03_latest_version",
    """SELECT l_partkey AS object_id, l_orderkey AS version, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS written_at FROM lineitem
       QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) = 1""",
)
def latest_version(spark, sf):
    versions = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("object_id"), F.col("l_orderkey").alias("version"), "l_linenumber", time_text("l_shipdate").alias("written_at"))
    return integrity.latest_version(versions, ["object_id"], ["written_at", "version", "l_linenumber"]).drop("l_linenumber")


# --- paging ----------------------------------------------------------------


@query("g01_list_by_status", f"WITH {TASKS} SELECT id, type, status, {_CREATED} FROM tasks WHERE status = 'pending' ORDER BY tasks.created_at DESC, id LIMIT 100")
def list_by_status(spark, sf):
    return _listing(catalog.list_by_status(tasks(spark, sf), "pending"))


@query(
    "g01_list_by_status_cursor",
    f"""WITH {TASKS} SELECT id, type, status, {_CREATED} FROM tasks
        WHERE status = 'failed' AND (tasks.created_at < TIMESTAMP '1999-05-05' OR (tasks.created_at = TIMESTAMP '1999-05-05' AND id > 500))
        ORDER BY tasks.created_at DESC, id LIMIT 50""",
)
def list_by_status_cursor(spark, sf):
    return _listing(catalog.list_by_status(tasks(spark, sf), "failed", 50, (datetime(1999, 5, 5), 500)))


@query("g02_list_by_type", f"WITH {TASKS} SELECT id, type, status, {_CREATED} FROM tasks WHERE type = 'ocr' ORDER BY tasks.created_at DESC, id LIMIT 100")
def list_by_type(spark, sf):
    return _listing(catalog.list_by_type(tasks(spark, sf), "ocr"))


_PAGE = """SELECT id, CAST((SELECT count(*) FROM tasks) AS BIGINT) AS total_items, CAST(ceil((SELECT count(*) FROM tasks) / 50.0) AS BIGINT) AS total_pages,
    3 < ceil((SELECT count(*) FROM tasks) / 50.0) AS has_next, true AS has_prev FROM tasks ORDER BY cost, id LIMIT 50 OFFSET 100"""


@query("g03_page_offset", f"WITH {TASKS} {_PAGE}")
def page_offset(spark, sf):
    page = catalog.page_offset(tasks(spark, sf).select("id", "cost"), ["cost", "id"], 3, 50)
    totals = ["total_items", "total_pages", "has_next", "has_prev"]
    return page.select(F.explode("items").alias("item"), *totals).select("item.id", *totals)


@query(
    "g03_page_past_end",
    f"""WITH {TASKS} SELECT 0 AS items, CAST(count(*) AS BIGINT) AS total_items, CAST(ceil(count(*) / 50.0) AS BIGINT) AS total_pages,
        false AS has_next, true AS has_prev FROM tasks""",
)
def page_past_end(spark, sf):
    """A page far behind the last one still reports the totals."""
    page = catalog.page_offset(tasks(spark, sf).select("id", "cost"), ["cost", "id"], 10_000_000, 50)
    return page.withColumn("items", F.size("items"))


@query(
    "g04_page_keyset",
    f"""WITH {TASKS}, page AS (SELECT cost, id FROM tasks WHERE cost > 100000 OR (cost = 100000 AND id > 5) ORDER BY cost, id LIMIT 25)
        SELECT cost, id, CASE WHEN (SELECT count(*) FROM page) = 25 THEN (SELECT max(cost) FROM page) END AS next_key,
               CASE WHEN (SELECT count(*) FROM page) = 25 THEN (SELECT arg_max(id, (cost, id)) FROM page) END AS next_id FROM page""",
)
def page_keyset(spark, sf):
    return catalog.page_keyset(tasks(spark, sf).select("cost", "id"), "cost", "id", (100000.0, 5), 25)


@query(
    "g05_due_tasks",
    f"""WITH {TASKS} SELECT id, type, status, {_CREATED} FROM tasks WHERE status = 'pending' AND type = 'scrape'
        AND (cost < 50000 OR tasks.created_at + to_days(30) <= TIMESTAMP '1998-01-01')""",
)
def due_tasks(spark, sf):
    scheduled = F.when(F.col("cost") >= 50000, F.col("created_at") + F.expr("INTERVAL 30 DAYS"))
    return _listing(catalog.due_tasks(tasks(spark, sf).withColumn("scheduled_at", scheduled), datetime(1998, 1, 1), "scrape"))
