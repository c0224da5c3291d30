"""Validation rules and quality gates (B2-B16, B32)."""

from pyspark.sql import functions as F

from gleanery.operators import validation as v
from gleanery.plans.spread import spread
from gleanery.queries import query
from gleanery.queries.views import (
    EXECUTIONS,
    OBJECTS,
    REQUESTS,
    TASKS,
    executions,
    objects,
    requests,
    rule_counts_sql,
    table,
    tasks,
    wide_table,
)


def _json(*columns):
    """A configuration as JSON text parsed to VARIANT; null members are absent."""
    return v.config_variant(F.to_json(F.struct(*columns)))


# --- B2, B3 ----------------------------------------------------------------

_JSON_LEN = "length(CAST(to_json({doc_id: doc_id, text: text, lang: lang, source: source}) AS VARCHAR))"


@query(
    "b02_content_rules",
    rule_counts_sql(
        "(SELECT *, " + _JSON_LEN + " AS n FROM (SELECT doc_id, text, lang, nullif(source, 'src1') AS source FROM documents))",
        [
            ("content_empty", "doc_id IS NULL AND text IS NULL AND lang IS NULL AND source IS NULL"),
            ("missing_source", "source IS NULL"),
            ("content_too_short", "n - CASE WHEN source IS NULL THEN length(',\"source\":null') ELSE 0 END < 100"),
            ("content_too_long", "n - CASE WHEN source IS NULL THEN length(',\"source\":null') ELSE 0 END > 20000"),
            ("text_too_long", "length(text) > 10000"),
            ("lang_too_long", "length(lang) > 10000"),
            ("source_too_long", "length(source) > 10000"),
        ],
    ),
)
def content_rules(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", F.nullif(F.col("source"), F.lit("src1")).alias("source"))
    return v.rule_counts(docs, v.content_rules(docs, min_len=100, max_len=20_000, required=["source"]))


@query(
    "b03_field_type_rules",
    """SELECT doc_id, CASE WHEN try_cast(split_part(text, ' ', 1) AS BIGINT) IS NULL THEN 'head_not_bigint' END AS error
       FROM documents""",
)
def field_type_rules(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.split_part("text", F.lit(" "), F.lit(1)).alias("head"), F.col("doc_id").cast("string").alias("number"))
    return v.first_error(docs, v.field_type_rules({"head": "bigint", "number": "bigint"})).select("doc_id", "error")


# --- B4 - B7 ---------------------------------------------------------------


@query(
    "b04_task_rules",
    "WITH "
    + TASKS
    + " "
    + rule_counts_sql(
        "tasks",
        [
            ("missing_fields", "priority = '5-LOW' OR status = 'failed'"),
            ("invalid_type", "priority = '4-NOT SPECIFIED'"),
            ("invalid_source", "cost < 1000 OR priority = '5-LOW'"),
            ("parameters_not_object", "status = 'failed'"),
            ("scrape_parameters", "type = 'scrape' AND status <> 'failed' AND cost < 200000"),
            ("ocr_parameters", "priority = '5-LOW' AND status <> 'failed' AND cost < 300000"),
        ],
    ),
)
def task_rules(spark, sf):
    t = spread(tasks(spark, sf))
    low, failed = F.col("priority") == "5-LOW", F.col("status") == "failed"
    kind = F.when(F.col("priority") == "4-NOT SPECIFIED", F.lit("index")).otherwise(F.col("type"))
    scrape = F.col("type") == "scrape"
    params = F.struct(
        F.when(scrape, F.lit("https://example.com")).alias("url"),
        F.when(scrape & (F.col("cost") >= 200000), F.lit("h1")).alias("selectors"),
        F.when(~scrape, F.lit("/a.pdf")).alias("file_path"),
        F.when(~scrape & (F.col("cost") >= 300000), F.lit("eng")).alias("language"),
    )
    source = F.when(~low, F.when(F.col("cost") < 1000, F.lit("  ")).otherwise(F.lit("https://example.com")))
    config = _json(kind.alias("type"), source.alias("source"), F.when(~failed, params).alias("parameters"))
    members = v.Members(F.col("config"))
    rules = v.task_rules(members)
    return v.rule_counts(members.read(t.select(config.alias("config"))), rules)


@query(
    "b05_task_create_rules",
    "WITH p AS (SELECT *, CASE WHEN contains(url, '#') THEN 'ocr' ELSE 'scrape' END AS type FROM pages) "
    + rule_counts_sql(
        "p",
        [
            ("invalid_type", "false"),
            ("source_missing", "false"),
            ("scrape_source", "type = 'scrape' AND NOT (starts_with(url, 'http://') OR starts_with(url, 'https://'))"),
            ("ocr_source", "type = 'ocr' AND NOT regexp_matches(url, '[.](pdf|png|jpg|jpeg)$')"),
            ("too_many_tags", "false"),
            ("tag_too_long", "length(split_part(html, '</h1>', 1)) > 100"),
            ("description_too_long", "length(html) > 1000"),
        ],
    ),
)
def task_create_rules(spark, sf):
    pages = table(spark, sf, "pages").select("url", "html", F.when(F.col("url").contains("#"), F.lit("ocr")).otherwise(F.lit("scrape")).alias("type"))
    tags = F.create_map(F.lit("head"), F.split_part("html", F.lit("</h1>"), F.lit(1)))
    rules = v.task_create_rules(F.col("type"), _json(F.col("url").alias("source")), tags, F.col("html"))
    return v.rule_counts(pages, rules)


@query(
    "b06_scrape_config_rules",
    "WITH "
    + REQUESTS
    + " "
    + rule_counts_sql(
        "requests",
        [
            ("source", "endpoint = 'signup'"),
            ("allowed_domains", "endpoint = 'view'"),
            ("requests_per_second", "seconds * 100 < 0.1 OR seconds * 100 > 100"),
            ("burst_size", "client < 1"),
            ("concurrent_requests", "client < 1 OR client > 32"),
            ("timeout_seconds", "second % 1000 < 1 OR second % 1000 > 300"),
            ("depth", "endpoint = 'click'"),
            ("rate", "false"),
            ("allowed_patterns", "endpoint = 'purchase'"),
        ],
    ),
)
def scrape_config_rules(spark, sf):
    r = spread(requests(spark, sf))
    e = F.col("endpoint")
    config = _json(
        F.when(e == "signup", F.lit("ftp://x")).otherwise(F.lit("https://example.com")).alias("source"),
        F.when(e == "view", F.array().cast("array<string>")).otherwise(F.array(F.lit("example.com"))).alias("allowed_domains"),
        F.struct((F.col("seconds") * 100).alias("requests_per_second"), F.col("client").alias("burst_size")).alias("rate_limit"),
        F.struct(
            F.col("client").alias("concurrent_requests"), F.pmod(F.unix_seconds("ts"), F.lit(1000)).alias("timeout_seconds")
        ).alias("performance"),
        F.when(e == "click", F.lit(-1)).otherwise(F.lit(2)).alias("depth"),
        F.struct(F.array(F.when(e == "purchase", F.lit("(unclosed")).otherwise(F.lit("^/ok/.*"))).alias("allowed_patterns")).alias("security"),
    )
    members = v.Members(F.col("config"))
    rules = v.scrape_config_rules(members)
    return v.rule_counts(members.read(r.select(config.alias("config"))), rules)


@query(
    "b07_ocr_config_rules",
    "WITH "
    + EXECUTIONS
    + " "
    + rule_counts_sql(
        "executions",
        [
            ("source_format", "status = 'failed'"),
            ("path_traversal", "status = 'running'"),
            ("output_format", "memory > 7.5"),
            ("languages", "quality > 0.95"),
            ("dpi", "seconds < 72"),
            ("page_segmentation_mode", "round(memory) > 5"),
            ("ocr_engine_mode", "false"),
            ("timeout_seconds", "seconds * 10 > 3600"),
            ("size_bytes", "seconds * 1048576 > 104857600"),
            ("extraction_type", "status = 'failed'"),
            ("quality_threshold", "quality > 0.975"),
            ("max_memory_mb", "memory < 0.5"),
            ("batch_size", "false"),
        ],
    ),
)
def ocr_config_rules(spark, sf):
    e = spread(executions(spark, sf))
    failed, running = F.col("status") == "failed", F.col("status") == "running"
    config = _json(
        F.when(failed, F.lit("/in/scan.gif")).when(running, F.lit("/in/../scan.pdf")).otherwise(F.lit("/in/SCAN.PDF")).alias("source_path"),
        F.when(F.col("memory") > 7.5, F.lit("docx")).otherwise(F.lit("JSON")).alias("output_format"),
        F.array(F.when(F.col("quality") > 0.95, F.lit("english")).otherwise(F.lit("eng"))).alias("languages"),
        F.struct(
            F.col("seconds").alias("dpi"),
            F.when(F.round("memory") > 5, F.lit(14)).otherwise(F.lit(13)).alias("page_segmentation_mode"),
            F.lit(3).alias("ocr_engine_mode"),
        ).alias("processing_options"),
        (F.col("seconds") * 10).alias("timeout_seconds"),
        (F.col("seconds") * 1048576).alias("size_bytes"),
        F.when(failed, F.lit("form")).otherwise(F.lit("mixed")).alias("extraction_type"),
        F.when(F.col("quality") > 0.975, F.lit(1.5)).otherwise(F.lit(1.0)).alias("quality_threshold"),
        F.when(F.col("memory") < 0.5, F.lit(0)).otherwise(F.lit(2048)).alias("max_memory_mb"),
        F.lit(10).alias("batch_size"),
    )
    members = v.Members(F.col("config"))
    rules = v.ocr_config_rules(members)
    return v.rule_counts(members.read(e.select(config.alias("config"))), rules)


@query(
    "b07_ocr_defaults",
    """SELECT p_partkey, '300' AS dpi, CAST(p_size AS VARCHAR) AS mode, 'eng' AS language,
              CASE WHEN p_size > 25 THEN lower(substr(p_type, 1, 3)) ELSE 'eng' END AS languages
       FROM part""",
)
def ocr_defaults(spark, sf):
    parts = table(spark, sf, "part")
    options = F.create_map(F.lit("page_segmentation_mode"), F.col("p_size").cast("string"))
    languages = F.when(F.col("p_size") > 25, F.array(F.substring("p_type", 1, 3)))
    merged, chosen = v.ocr_defaults(options, languages)
    return parts.select(
        "p_partkey",
        merged["dpi"].alias("dpi"),
        merged["page_segmentation_mode"].alias("mode"),
        merged["language"].alias("language"),
        F.array_join(chosen, ",").alias("languages"),
    )


# --- B8 - B13 --------------------------------------------------------------


@query(
    "b08_execution_state_rules",
    "WITH "
    + EXECUTIONS
    + " "
    + rule_counts_sql(
        "(SELECT status, CASE WHEN seconds > 30 THEN end_time END AS end_time, CASE WHEN quality < 0.99 THEN result END AS result, "
        "CASE WHEN seconds > 450 THEN 'late' ELSE error_message END AS error FROM executions)",
        [
            ("completed_without_end", "status = 'completed' AND end_time IS NULL"),
            ("completed_without_result", "status = 'completed' AND result IS NULL"),
            ("completed_with_error", "status = 'completed' AND error IS NOT NULL"),
            ("failed_without_end", "status = 'failed' AND end_time IS NULL"),
            ("failed_without_error", "status = 'failed' AND error IS NULL"),
            ("failed_with_result", "status = 'failed' AND result IS NOT NULL"),
        ],
    ),
)
def execution_state_rules(spark, sf):
    e = executions(spark, sf)
    rules = v.execution_state_rules(
        F.col("status"),
        F.when(F.col("seconds") > 30, F.col("end_time")),
        F.when(F.col("quality") < 0.99, F.col("result")),
        F.when(F.col("seconds") > 450, F.lit("late")).otherwise(F.col("error_message")),
    )
    return v.rule_counts(e, rules)


@query(
    "b09_object_rules",
    "WITH "
    + OBJECTS
    + " "
    + rule_counts_sql(
        "(SELECT *, CASE class WHEN 'raw' THEN storage_path WHEN 'documents' THEN upper(storage_path) WHEN 'ocr' THEN 'gs://d/' || id "
        "ELSE replace(storage_path, '/', '') END AS path FROM objects)",
        [
            ("missing_field", "false"),
            ("path_scheme", "class IN ('documents', 'logs')"),
            ("path_parts", "class = 'logs'"),
            ("bucket_length", "CASE class WHEN 'ocr' THEN true WHEN 'logs' THEN length(path) > 63 ELSE false END"),
            ("bucket_case", "class = 'documents'"),
            ("content_type", "false"),
            ("size", "size_bytes <= 100 AND size_bytes - 100 <= 0"),
        ],
    ),
)
def object_rules(spark, sf):
    o = objects(spark, sf)
    path = (
        F.when(F.col("class") == "raw", F.col("storage_path"))
        .when(F.col("class") == "documents", F.upper("storage_path"))
        .when(F.col("class") == "ocr", F.concat(F.lit("gs://d/"), F.col("id").cast("string")))
        .otherwise(F.replace(F.col("storage_path"), F.lit("/"), F.lit("")))
    )
    rules = v.object_rules(path, F.col("content_type"), F.col("size_bytes") - 100, [F.col("id"), F.col("execution_id")])
    return v.rule_counts(o, rules)


def _metadata(spark, sf):
    """Documents with nested metadata; some hold nulls at different depths, some are no object."""
    missing = lambda n, c: F.when(F.col("doc_id") % n == 0, F.lit(None)).otherwise(c)
    body = F.struct(
        F.col("n_chars").alias("chars"),
        missing(5, F.col("lang")).alias("lang"),
        F.array(F.col("source"), missing(7, F.col("lang")), missing(3, F.col("source"))).alias("tags"),
        F.struct(F.array(F.struct(missing(11, F.col("source")).alias("c"), F.lit(0.5).alias("d"))).alias("b"), missing(2, F.lit(True)).alias("e")).alias("a"),
    )
    text = F.when(F.col("doc_id") % 13 == 0, F.to_json(F.array("source"))).otherwise(F.to_json(body, {"ignoreNullFields": "false"}))
    return table(spark, sf, "documents").select("doc_id", v.config_variant(text).alias("metadata"))


_METADATA = """metadata AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN to_json([source]) ELSE to_json({
       chars: n_chars, lang: CASE WHEN doc_id % 5 <> 0 THEN lang END,
       tags: [source, CASE WHEN doc_id % 7 <> 0 THEN lang END, CASE WHEN doc_id % 3 <> 0 THEN source END],
       a: {b: [{c: CASE WHEN doc_id % 11 <> 0 THEN source END, d: 0.5}], e: CASE WHEN doc_id % 2 <> 0 THEN true END}}) END AS body FROM documents),
     tree AS (SELECT doc_id, regexp_replace('metadata' || substr(t.fullkey, 2), '\\[[0-9]+\\]', '[]', 'g') AS path, t.type AS type FROM metadata, json_tree(body) t)"""


@query(
    "b10_metadata_types",
    f"""WITH {_METADATA} SELECT doc_id, path, CASE type WHEN 'NULL' THEN 'VOID' ELSE type END AS kind, count(*) AS values FROM tree
        WHERE CASE WHEN path = 'metadata' THEN type <> 'OBJECT' ELSE type = 'NULL' END GROUP BY ALL""",
)
def metadata_types(spark, sf):
    return v.metadata_type_violations(_metadata(spark, sf), "doc_id", "metadata")


@query("b10_metadata_values", f"WITH {_METADATA} SELECT path, count(*) AS values, count(*) FILTER (WHERE type IN ('OBJECT', 'ARRAY')) AS nested FROM tree GROUP BY path")
def metadata_values(spark, sf):
    walked = v.metadata_values(_metadata(spark, sf), "doc_id", "metadata")
    return walked.groupBy("path").agg(F.count("*").alias("values"), F.count_if(F.col("kind").isin("OBJECT", "ARRAY")).alias("nested"))


@query(
    "b11_source_rules",
    "WITH s AS (SELECT s_name AS name, s_nationkey AS n, CASE WHEN s_nationkey < 10 THEN 'scrape' WHEN s_nationkey < 20 THEN 'ocr' ELSE 'api' END AS type, s_acctbal AS b FROM supplier) "
    + rule_counts_sql(
        "s",
        [
            ("type", "type = 'api'"),
            ("name", "false"),
            ("credentials", "type = 'ocr'"),
            ("configuration", "(type = 'scrape' AND b < 0) OR (type = 'ocr' AND b >= 0)"),
            ("metadata", "b > 5000"),
        ],
    ),
)
def source_rules(spark, sf):
    n, b = F.col("s_nationkey"), F.col("s_acctbal")
    kind = F.when(n < 10, F.lit("scrape")).when(n < 20, F.lit("ocr")).otherwise(F.lit("api"))
    rules = v.source_rules(
        F.col("s_name"),
        kind,
        F.create_map(F.lit("api_key"), F.lit("k")),
        F.create_map(F.when(b < 0, F.lit("output_format")).otherwise(F.lit("base_url")), F.lit("x")),
        F.create_map(F.when(b > 5000, F.lit("note")).otherwise(F.lit("content_type")), F.lit("text/html")),
    )
    return v.rule_counts(table(spark, sf, "supplier"), rules)


@query(
    "b12_id_time_rules",
    rule_counts_sql(
        "events",
        [
            ("uuid_not_uuid", "event_type = 'error'"),
            ("plain_not_uuid", "true"),
            ("z_not_iso_time", "event_type = 'click'"),
            ("day_not_iso_time", "event_type = 'view'"),
        ],
    ),
)
def id_time_rules(spark, sf):
    e = table(spark, sf, "events")
    kind = F.col("event_type")
    h = F.md5(F.col("event_id").cast("string"))
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    rules = v.id_time_rules(
        {"uuid": F.when(kind == "error", F.substring(uuid, 2, 40)).otherwise(uuid), "plain": F.col("event_id").cast("string")},
        {
            "z": F.when(kind == "click", F.concat(F.lit("2024-13-"), F.date_format("ts", "dd'T'HH:mm:ss"))).otherwise(F.concat(stamp, F.lit("Z"))),
            "day": F.when(kind == "view", F.date_format("ts", "dd.MM.yyyy")).otherwise(F.date_format("ts", "yyyy-MM-dd")),
        },
    )
    return v.rule_counts(e, rules)


@query(
    "b13_config_section_check",
    """WITH c AS (SELECT c_custkey AS id, c_nationkey AS n, c_acctbal AS b, c_mktsegment AS seg FROM customer),
       rows AS (
         SELECT id, 'API' AS section, n >= 5 AS valid, 'Invalid API configuration structure' AS m FROM c
         UNION ALL SELECT id, 'Storage', b >= 0, 'Invalid storage configuration structure' FROM c
         UNION ALL SELECT id, 'Production', b >= 0 AND n * 100 <= 1000, 'Production security requirements not met'
                   FROM c WHERE seg = 'BUILDING')
       SELECT id, section, valid, CASE WHEN valid THEN 'Valid' ELSE 'Invalid' END AS status,
              CASE WHEN valid THEN '' ELSE m END AS message FROM rows""",
)
def config_section_check(spark, sf):
    n, b = F.col("c_nationkey"), F.col("c_acctbal")
    config = _json(
        F.struct(
            F.when(n >= 5, F.lit(30)).alias("timeout"), F.struct((n * 100).alias("max_requests")).alias("rate_limit")
        ).alias("api"),
        F.struct(F.struct(F.when(b >= 0, F.lit(True)).alias("enabled")).alias("encryption"), F.struct(F.lit(90).alias("days")).alias("retention")).alias("storage"),
    )
    env = F.when(F.col("c_mktsegment") == "BUILDING", F.lit("prod")).otherwise(F.lit("dev"))
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), env.alias("env"), config.alias("config"))
    return v.config_section_check(rows, "config", "env").drop("env")


# --- B14 - B16, B32 --------------------------------------------------------

_NOISE = "(length(text) - length(translate(text, '?#@$', ''))) / length(text)"
_DOC_ERRORS = f"""SELECT doc_id, source, concat_ws(',', CASE WHEN length(text) < 50 THEN 'short' END, CASE WHEN length(text) > 5000 THEN 'long' END,
      CASE WHEN {_NOISE} > 0.02 THEN 'noisy' END) AS details FROM documents"""


def _doc_rules():
    from gleanery.functions.text import noise_ratio

    t = F.col("text")
    return [("short", F.length(t) < 50), ("long", F.length(t) > 5000), ("noisy", noise_ratio(t) > 0.02)]


@query("b14_split_valid_accepted", f"SELECT doc_id, source FROM ({_DOC_ERRORS}) WHERE details = ''")
def split_valid_accepted(spark, sf):
    accepted, _ = v.split_valid(wide_table(spark, sf, "documents"), _doc_rules())
    return accepted.select("doc_id", "source")


@query(
    "b14_split_valid_quarantine",
    f"SELECT doc_id, 'failed' AS status, split_part(details, ',', 1) AS error, details FROM ({_DOC_ERRORS}) WHERE details <> ''",
)
def split_valid_quarantine(spark, sf):
    _, quarantine = v.split_valid(wide_table(spark, sf, "documents"), _doc_rules())
    return quarantine.select("doc_id", "status", "error", F.array_join("details", ",").alias("details"))


@query(
    "b15_ocr_quality",
    f"SELECT doc_id, (n_chars % 100) / 100 >= 0.85 AND trim(text) <> '' AND {_NOISE} <= 0.1 AS passed FROM documents",
)
def ocr_quality(spark, sf):
    docs = wide_table(spark, sf, "documents").withColumn("confidence", F.pmod("n_chars", F.lit(100)) / 100)
    return v.ocr_quality(docs, "text", "confidence").select("doc_id", "passed")


@query(
    "b16_quality_gate",
    "WITH "
    + EXECUTIONS
    + """ SELECT kind, threshold, passed, count(*) AS n FROM (
           SELECT kind, threshold, coalesce(quality >= threshold, false) AS passed
           FROM (SELECT quality, CASE status WHEN 'completed' THEN 'text' WHEN 'failed' THEN 'table' ELSE 'form' END AS kind,
                        CASE status WHEN 'completed' THEN 0.85::DOUBLE WHEN 'failed' THEN 0.9::DOUBLE END AS threshold FROM executions)) GROUP BY ALL""",
)
def quality_gate(spark, sf):
    kind = F.when(F.col("status") == "completed", F.lit("text")).when(F.col("status") == "failed", F.lit("table")).otherwise(F.lit("form"))
    e = executions(spark, sf).select(kind.alias("kind"), "quality")
    return v.quality_gate(e, "kind", "quality").groupBy("kind", "threshold", "passed").agg(F.count("*").alias("n"))


@query(
    "b16_quality_gate_final",
    "WITH " + EXECUTIONS + " SELECT status, count(*) FILTER (WHERE quality >= 0.98) AS passed FROM executions GROUP BY status",
)
def quality_gate_final(spark, sf):
    e = executions(spark, sf).select("status", "quality")
    return v.quality_gate(e, "status", "quality", final=True).groupBy("status").agg(F.count_if("passed").alias("passed"))


@query("b32_coerce_numeric", "SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS size, p_brand AS brand FROM part")
def coerce_numeric(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("string").alias("size"), F.col("p_brand").alias("brand"))
    return v.coerce_numeric(parts, ["size", "brand"])
