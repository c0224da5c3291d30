"""Selector matches, tables, recognised words, routing, registries (C, J)."""

from pyspark.sql import functions as F

from gleanery.operators import extract, recognition, registry
from gleanery.plans import journeys
from gleanery.plans.spread import spread
from gleanery.queries import query
from gleanery.queries.cleaning import clean_sql
from gleanery.queries.views import table, wide_table

_DECODE = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace({c}, '&#x27;', chr(39)), '&middot;', '\u00b7'), '&copy;', '\u00a9'),"
    " '&quot;?', chr(34), 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g')"
)


def _tag_sql(tag: str, name: str) -> str:
    text = f"unnest(regexp_extract_all(html, '<{tag}( [^>]*)?>([^<]*)</{tag}>', 2))"
    index = f"unnest(range(len(regexp_extract_all(html, '<{tag}( [^>]*)?>([^<]*)</{tag}>', 2))))"
    return f"SELECT page_id, '{name}' AS name, {index} AS match_idx, {text} AS value FROM pages"


@query(
    "c03_extract_selectors",
    f"""WITH m AS ({_tag_sql('title', 'title')} UNION ALL {_tag_sql('h1', 'heading')} UNION ALL {_tag_sql('a', 'link')})
        SELECT CAST(page_id AS VARCHAR) AS page_id, name, CAST(match_idx AS INTEGER) AS match_idx, {clean_sql(_DECODE.format(c='value'))} AS value FROM m""",
)
def extract_selectors(spark, sf):
    return extract.extract_selectors(wide_table(spark, sf, "pages"), {"title": "title", "heading": "h1", "link": "a"})


_PIECES = "list_slice(string_split(html, '<p>'), 2, len(string_split(html, '<p>')))"
_INNER = "regexp_replace(regexp_extract(piece, '(?s)^(.*?)(</p>|</article>|<ul>|<div|<h[1-6]>|$)', 1), '<[^>]*>', '', 'g')"


@query(
    "c03_extract_paragraphs",
    f"""WITH p AS (SELECT page_id, unnest({_PIECES}) AS piece, unnest(range(len({_PIECES}))) AS i FROM pages),
        a AS (SELECT page_id, unnest(regexp_extract_all(html, '<div class="ad">([^<]*)</div>', 1)) AS piece,
                     unnest(range(len(regexp_extract_all(html, '<div class="ad">([^<]*)</div>', 1)))) AS i FROM pages),
        m AS (SELECT page_id, 'paragraph' AS name, i, {_INNER} AS value FROM p UNION ALL SELECT page_id, 'ad', i, piece FROM a)
        SELECT CAST(page_id AS VARCHAR) AS page_id, name, CAST(i AS INTEGER) AS match_idx, {clean_sql(_DECODE.format(c='value'))} AS value FROM m""",
)
def extract_paragraphs(spark, sf):
    return extract.extract_selectors(wide_table(spark, sf, "pages"), {"paragraph": "p", "ad": ".ad"})


def _order_pages(spark, sf):
    """One page per order: two rows about it, and a table without rows for the cheap ones."""
    cell = lambda c: F.concat(F.lit("<td>"), c.cast("string"), F.lit("</td>"))
    key, owner = F.col("o_orderkey"), F.col("o_custkey")
    first = F.concat(F.lit("<tr>"), cell(key), cell(owner), cell(F.col("o_orderdate")), cell(F.col("o_orderstatus")))
    second = F.concat(F.lit("<tr>"), cell(key + 1), cell(owner * 2), F.lit("<td> <td><b>"), F.col("o_orderpriority"), F.lit("</b>"))
    head = F.lit("<p>Order<table><thead><tr><th>order<th>owner &amp; co<th>created<th>note</thead><tbody>")
    empty = F.when(F.col("o_totalprice") < 100_000, F.lit("<table><tr><th>a</th><th>b</th></tr></table>")).otherwise(F.lit(""))
    orders = spread(table(spark, sf, "orders"))
    return orders.select(key.alias("page_id"), F.concat(head, first, second, F.lit("</table>"), empty).alias("html"))


@query(
    "c01_extract_tables",
    """SELECT CAST(o_orderkey AS VARCHAR) AS page_id, CAST(0 AS INTEGER) AS table_idx, CAST(r AS INTEGER) AS row_idx,
              CAST(o_orderkey + r AS VARCHAR) AS "order", CAST(o_custkey * (r + 1) AS VARCHAR) AS owner,
              CASE r WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS created, CASE r WHEN 0 THEN o_orderstatus ELSE o_orderpriority END AS note
       FROM orders, (SELECT unnest([0, 1]) AS r)""",
)
def extract_tables(spark, sf):
    records = extract.extract_tables(_order_pages(spark, sf))
    names = {"order": "order", "owner": "owner & co", "created": "created", "note": "note"}
    return records.select("page_id", "table_idx", "row_idx", *[F.col("record")[k].alias(a) for a, k in names.items()])


@query(
    "c02_validate_tables",
    """SELECT CAST(o_orderkey AS VARCHAR) AS page_id, CAST(i AS INTEGER) AS table_idx, CAST(CASE i WHEN 0 THEN 2 ELSE 0 END AS INTEGER) AS rows,
              i = 0 AS valid, CASE i WHEN 1 THEN 'too few rows' END AS problem
       FROM orders, (SELECT unnest([0, 1]) AS i) WHERE i = 0 OR o_totalprice < 100000""",
)
def validate_tables(spark, sf):
    judged = extract.validate_tables(extract.scan_tables(_order_pages(spark, sf)))
    return judged.select("page_id", "table_idx", F.col("row_count").alias("rows"), "valid", "problem")


@query("c01_pages_without_tables", "SELECT CAST(page_id AS VARCHAR) AS page_id, 'No tables found' AS error FROM pages")
def pages_without_tables(spark, sf):
    return extract.pages_without_tables(extract.scan_tables(wide_table(spark, sf, "pages")))


def _words(spark, sf):
    """Documents split at blanks as recognised words; short words are sure, long ones less so."""
    docs = wide_table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("word_idx", "text"))
    conf = F.when(F.length("text") == 0, F.lit(-1.0)).otherwise(F.lit(100.0) - F.length("text"))
    n = F.length("text")
    return docs.select("doc_id", "word_idx", "text", conf.alias("conf"), F.lit(0).alias("left"), F.lit(0).alias("top"), n.alias("width"), F.lit(10).alias("height"))


_WORDS = """words AS (SELECT doc_id, i, w, CASE WHEN length(w) = 0 THEN -1 ELSE 100 - length(w) END AS conf
     FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS i FROM documents))"""
_WS = r"\s\x0B\x1C-\x1F\x{85}\p{Z}"


@query(
    "c04_assemble_text",
    rf"""WITH {_WORDS}, c AS (SELECT doc_id, round(coalesce(avg(CASE WHEN conf <> -1 THEN conf END), 0) / 100, 6) AS confidence, count(*) AS boxes FROM words GROUP BY doc_id)
        SELECT doc_id, CAST(0 AS BIGINT) AS part, text, confidence, CAST(len(regexp_extract_all(text, '[^{_WS}]+')) AS BIGINT) AS word_count, CAST(boxes AS INTEGER) AS boxes
        FROM documents JOIN c USING (doc_id)""",
)
def assemble_text(spark, sf):
    d = recognition.assemble_text(_words(spark, sf))
    return d.select("doc_id", "part", "text", F.round("confidence", 6).alias("confidence"), "word_count", F.size("boxes").alias("boxes"))


@query(
    "c04_assemble_text_parts",
    rf"""WITH {_WORDS}, c AS (SELECT doc_id, round(coalesce(avg(CASE WHEN conf <> -1 THEN conf END), 0) / 100, 6) AS confidence FROM words GROUP BY doc_id)
        SELECT doc_id, i // 100 AS part, string_agg(w, ' ' ORDER BY i) AS text, confidence FROM words JOIN c USING (doc_id) GROUP BY ALL""",
)
def assemble_text_parts(spark, sf):
    d = recognition.assemble_text(_words(spark, sf), part_words=100)
    return d.select("doc_id", "part", "text", F.round("confidence", 6).alias("confidence"))


@query(
    "c04_text_confidence",
    f"WITH {_WORDS} SELECT doc_id, round(coalesce(avg(CASE WHEN conf <> -1 THEN conf END), 0) / 100, 6) AS confidence, count(*) AS boxes FROM words GROUP BY doc_id",
)
def text_confidence(spark, sf):
    return recognition.text_confidence(_words(spark, sf)).select("doc_id", F.round("confidence", 6).alias("confidence"), "boxes")


@query(
    "c05_assemble_table",
    """SELECT l_orderkey AS doc_id, count(DISTINCT l_linenumber) AS rows, count(DISTINCT l_suppkey % 3) AS columns, count(*) AS cells,
              round(avg(1 - l_discount), 6) AS confidence,
              count(*) >= 4 AND sum(CAST(1 - l_discount AS DECIMAL(20, 9))) >= count(*) * CAST(0.9 AS DECIMAL(20, 9)) AS valid
       FROM lineitem GROUP BY l_orderkey""",
)
def assemble_table(spark, sf):
    cells = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"),
        F.array((F.col("l_suppkey") % 3).cast("int"), F.col("l_linenumber"), F.lit(10), F.lit(10)).alias("coordinates"),
        (F.lit(1.0) - F.col("l_discount")).alias("confidence"),
    )
    return recognition.assemble_table(cells, ("doc_id",)).withColumn("confidence", F.round("confidence", 6))


@query("c06_format_ocr_txt", "SELECT doc_id, CAST(0 AS BIGINT) AS part, text AS body FROM documents")
def format_ocr_txt(spark, sf):
    return recognition.format_ocr(recognition.assemble_text(_words(spark, sf)), "txt")


@query(
    "c06_format_ocr_json",
    f"""WITH {_WORDS} SELECT doc_id, count(*) AS boxes, max(d.text) AS text, sum(length(w)) AS width, round(CAST(sum(conf) AS DOUBLE), 4) AS conf
        FROM words JOIN documents d USING (doc_id) GROUP BY doc_id""",
)
def format_ocr_json(spark, sf):
    """Format as JSON, then read the JSON back."""
    made = recognition.format_ocr(recognition.assemble_text(_words(spark, sf)), "JSON")
    schema = "text string, words array<struct<text:string,conf:double>>, boxes array<array<bigint>>, confidence double"
    back = made.select("doc_id", F.from_json("body", schema).alias("b"))
    total = lambda xs, f: F.aggregate(xs, f.cast("double") * 0, lambda a, x: a + x)
    widths = F.aggregate(F.transform("b.boxes", lambda x: x[2]), F.lit(0).cast("long"), lambda a, x: a + x)
    confs = total(F.transform("b.words", lambda x: x["conf"]), F.lit(0.0))
    return back.select("doc_id", F.size("b.boxes").cast("long").alias("boxes"), F.col("b.text").alias("text"), widths.alias("width"), F.round(confs, 4).alias("conf"))


@query(
    "c07_route_by_type",
    """SELECT doc_id, CASE lang WHEN 'en' THEN upper(source) WHEN 'fr' THEN CAST(n_chars AS VARCHAR) END AS result,
              CASE WHEN lang NOT IN ('en', 'fr') THEN 'failed' END AS status, CASE WHEN lang NOT IN ('en', 'fr') THEN 'Invalid type: ' || lang END AS error
       FROM documents""",
)
def route_by_type(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    handlers = {
        "en": lambda df: df.select("doc_id", F.upper("source").alias("result")),
        "fr": lambda df: df.select("doc_id", F.col("n_chars").cast("string").alias("result")),
    }
    return extract.route_by_type(docs, "lang", handlers).select("doc_id", "result", "status", "error")


@query(
    "c08_recognise",
    rf"""WITH {_WORDS}, c AS (SELECT doc_id, coalesce(avg(CASE WHEN conf <> -1 THEN conf END), 0) / 100 AS confidence FROM words GROUP BY doc_id)
        SELECT doc_id, CAST(0 AS BIGINT) AS part, text AS body FROM documents JOIN c USING (doc_id)
        WHERE confidence >= 0.85 AND regexp_matches(text, '[^{_WS}]') AND (length(text) - length(translate(text, '?#@$', ''))) / length(text) <= 0.1""",
)
def recognise(spark, sf):
    return journeys.recognise(_words(spark, sf), "txt")


@query(
    "c08_scrape_text",
    f"""WITH m AS ({_tag_sql('h1', 'heading')}), c AS (SELECT CAST(page_id AS VARCHAR) AS page_id, {clean_sql(_DECODE.format(c='value'))} AS value FROM m)
        SELECT page_id, value, length(value) > 10000 OR value = '' AS rejected FROM c""",
)
def scrape_text(spark, sf):
    accepted, quarantine = journeys.scrape_text(wide_table(spark, sf, "pages"), {"heading": "h1"})
    a = accepted.select("page_id", "value", F.lit(False).alias("rejected"))
    return a.unionByName(quarantine.select("page_id", "value", F.lit(True).alias("rejected")))


# --- registries ------------------------------------------------------------


@query(
    "j01_registered_extractor",
    f"WITH m AS ({_tag_sql('h1', 'heading')}) SELECT CAST(page_id AS VARCHAR) AS page_id, {clean_sql(_DECODE.format(c='value'))} AS value FROM m",
)
def registered_extractor(spark, sf):
    if "headings" not in registry.extractors.names():
        registry.register_extractor("headings", lambda pages: extract.extract_selectors(pages, {"h": "h1"}).select("page_id", "value"))
    return registry.run_extractor("headings", wide_table(spark, sf, "pages"))


@query(
    "j01_table_function",
    """SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS target FROM pages""",
)
def table_function(spark, sf):
    registry.register_table_function(spark, "page_links", extract.PageLinks, "page_id long, target string")
    wide_table(spark, sf, "pages").createOrReplaceTempView("gleanery_pages")
    return spark.sql("SELECT page_id, target FROM page_links(TABLE(SELECT page_id, html FROM gleanery_pages))")


def _samples(spark, sf):
    return table(spark, sf, "events").select(F.col("event_type").alias("endpoint"), "value", "ts", F.col("event_id").alias("sample_id"))


@query("j02_counter_metric", "SELECT event_type AS endpoint, round(sum(value), 4) AS value FROM events GROUP BY event_type")
def counter_metric(spark, sf):
    if "cost_total" not in registry.metric_kinds.names():
        registry.register_metric("cost_total", "counter", ["endpoint"])
    return registry.collect_metric("cost_total", _samples(spark, sf)).withColumn("value", F.round("value", 4))


@query("j02_gauge_metric", "SELECT event_type AS endpoint, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY event_type")
def gauge_metric(spark, sf):
    if "last_cost" not in registry.metric_kinds.names():
        registry.register_metric("last_cost", "gauge", ["endpoint"])
    return registry.collect_metric("last_cost", _samples(spark, sf))


@query(
    "j02_histogram_metric",
    """SELECT event_type AS endpoint, CAST(le AS VARCHAR) AS le, count(*) FILTER (WHERE value <= le) AS bucket_count
       FROM events, (SELECT unnest([10.0::DOUBLE, 100.0::DOUBLE, 'inf'::DOUBLE]) AS le) GROUP BY ALL""",
)
def histogram_metric(spark, sf):
    if "cost_seconds" not in registry.metric_kinds.names():
        registry.register_metric("cost_seconds", "histogram", ["endpoint"], [10, 100])
    h = registry.collect_metric("cost_seconds", _samples(spark, sf))
    return h.select("endpoint", F.when(F.col("le") == float("inf"), F.lit("inf")).otherwise(F.col("le").cast("string")).alias("le"), "bucket_count")


@query("j03_registered_rules", "SELECT doc_id, CASE WHEN n_chars > 5000 THEN 'long' ELSE '' END AS errors FROM documents")
def registered_rules(spark, sf):
    if "document_size" not in registry.rule_sets.names():
        registry.register_rules("document_size", lambda: [("long", F.col("n_chars") > 5000)])
    checked = registry.validate_as("document_size", table(spark, sf, "documents").select("doc_id", "n_chars"))
    return checked.select("doc_id", F.array_join("errors", ",").alias("errors"))
