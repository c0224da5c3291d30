from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.operators import catalog, registry
from gleanery.operators import validation as v


def broken(spark, rules, json_text):
    """Names of the rules a configuration breaks."""
    df = spark.createDataFrame([(json_text,)], "j string").select(v.config_variant(F.col("j")).alias("c"))
    return set(v.validate(df, rules(F.col("c"))).first()["errors"])


TASK = '{"type":"scrape","source":"https://x","parameters":{"url":"https://x","selectors":{"title":"h1"}}}'


@pytest.mark.parametrize(
    "config, errors",
    [
        (TASK, set()),
        ('{"type":"ocr","source":"a.pdf","parameters":{"file_path":"a.pdf","language":"eng"}}', set()),
        ('{"type":"ocr","source":"a.pdf","parameters":{"file_path":"a.pdf"}}', {"ocr_parameters"}),
        ('{"type":"scrape","source":" ","parameters":{"url":"u"}}', {"invalid_source", "scrape_parameters"}),
        ('{"type":"crawl","source":"x","parameters":[]}', {"invalid_type", "parameters_not_object"}),
        ('{"type":7,"source":8}', {"missing_fields", "invalid_type", "invalid_source", "parameters_not_object"}),
        ("not json", {"missing_fields", "invalid_type", "invalid_source", "parameters_not_object"}),
    ],
)
def test_task_rules(spark, config, errors):
    assert broken(spark, v.task_rules, config) == errors


SCRAPE = '{"source":"https://x","allowed_domains":["x"]%s}'


@pytest.mark.parametrize(
    "more, errors",
    [
        ("", set()),
        (',"rate_limit":{"requests_per_second":0.1,"burst_size":1},"performance":{"concurrent_requests":32,"timeout_seconds":300}', set()),
        (',"rate_limit":{"requests_per_second":0.05}', {"requests_per_second"}),
        (',"rate_limit":{"requests_per_second":101,"burst_size":0}', {"requests_per_second", "burst_size"}),
        (',"performance":{"concurrent_requests":33,"timeout_seconds":301}', {"concurrent_requests", "timeout_seconds"}),
        (',"performance":{"concurrent_requests":0,"timeout_seconds":0}', {"concurrent_requests", "timeout_seconds"}),
        (',"performance":{"timeout_seconds":"60"}', {"timeout_seconds"}),
        (',"depth":0,"rate_limit":2.5', set()),
        (',"depth":-1,"rate_limit":0', {"depth", "rate"}),
        (',"depth":1.5', {"depth"}),
        (',"security":{"allowed_patterns":["^/a","(b"]}', {"allowed_patterns"}),
        (',"security":{"allowed_patterns":["^/a"]}', set()),
    ],
)
def test_scrape_config_rules(spark, more, errors):
    assert broken(spark, v.scrape_config_rules, SCRAPE % more) == errors


OCR = '{"source_path":"/in/a.PDF","output_format":"JSON"%s}'


@pytest.mark.parametrize(
    "more, errors",
    [
        ("", set()),
        (',"processing_options":{"dpi":72,"page_segmentation_mode":0,"ocr_engine_mode":3},"timeout_seconds":3600', set()),
        (',"processing_options":{"dpi":71,"page_segmentation_mode":14,"ocr_engine_mode":4}', {"dpi", "page_segmentation_mode", "ocr_engine_mode"}),
        (',"processing_options":{"dpi":300.5}', {"dpi"}),
        (',"languages":["invalid"]', {"languages"}),
        (',"languages":["eng","deu"]', set()),
        (',"timeout_seconds":0,"size_bytes":0', {"timeout_seconds", "size_bytes"}),
        (',"size_bytes":104857601', {"size_bytes"}),
        (',"extraction_type":"form","quality_threshold":0', {"extraction_type", "quality_threshold"}),
        (',"quality_threshold":1.0,"max_memory_mb":1,"batch_size":1', set()),
        (',"max_memory_mb":0,"batch_size":-1', {"max_memory_mb", "batch_size"}),
    ],
)
def test_ocr_config_rules(spark, more, errors):
    assert broken(spark, v.ocr_config_rules, OCR % more) == errors


def test_ocr_paths(spark):
    assert broken(spark, v.ocr_config_rules, '{"source_path":"/a/../b.pdf","output_format":"txt"}') == {"path_traversal"}
    assert broken(spark, v.ocr_config_rules, '{"source_path":"/a/b.gif","output_format":"docx"}') == {"source_format", "output_format"}


def test_task_create_limits(spark):
    tags = F.from_json("t", "map<string,string>")
    rules = v.task_create_rules(F.col("k"), v.config_variant(F.col("j")), tags, F.col("d"))
    rows = [
        ("scrape", '{"source":"http://x"}', '{"a":"b"}', "x" * 1000),
        ("ocr", '{"source":"a.PDF"}', '{"%s":"b"}' % ("k" * 51), "x" * 1001),
        ("ocr", '{"source":"a.jpeg"}', "{%s}" % ",".join(f'"t{i}":"v"' for i in range(11)), None),
        ("x", "{}", None, None),
    ]
    df = v.validate(spark.createDataFrame(rows, "k string, j string, t string, d string"), rules)
    assert [set(r.errors) for r in df.collect()] == [
        set(),
        {"ocr_source", "tag_too_long", "description_too_long"},
        {"too_many_tags"},
        {"invalid_type", "source_missing"},
    ]


def test_execution_states(spark):
    rules = v.execution_state_rules(F.col("s"), F.col("e"), F.col("r"), F.col("m"))
    now = datetime(2024, 1, 1)
    rows = [
        ("completed", now, "{}", None),
        ("completed", None, None, "x"),
        ("failed", now, None, "x"),
        ("failed", None, "{}", None),
        ("running", None, None, None),
    ]
    df = v.validate(spark.createDataFrame(rows, "s string, e timestamp, r string, m string"), rules)
    assert [set(r.errors) for r in df.collect()] == [
        set(),
        {"completed_without_end", "completed_without_result", "completed_with_error"},
        set(),
        {"failed_without_end", "failed_with_result", "failed_without_error"},
        set(),
    ]


def test_object_paths(spark):
    rules = v.object_rules(F.col("p"), F.col("c"), F.col("n"))
    rows = [("gs://abc/x", "a/b", None), ("s3://abc/x", "a/b", 1), ("gs://ab/x", "ab", 0), ("gs://Abc", "a/b", 5), (None, None, None)]
    df = v.validate(spark.createDataFrame(rows, "p string, c string, n long"), rules)
    got = [set(r.errors) for r in df.collect()]
    assert got[0] == set()
    assert "path_scheme" in got[1]
    assert got[2] == {"bucket_length", "content_type", "size"}
    assert got[3] == {"path_parts", "bucket_case"}
    assert {"path_scheme", "content_type"} <= got[4]


def test_metadata_types_on_the_schema():
    ok = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.ArrayType(T.StructType([T.StructField("c", T.DoubleType())])))])
    bad = T.StructType([T.StructField("x", T.BinaryType()), T.StructField("y", T.ArrayType(T.DecimalType(5, 2))), T.StructField("z", T.LongType())])
    assert v.metadata_type_rules(ok) == []
    assert v.metadata_type_rules(bad) == ["metadata.x", "metadata.y[]"]


def test_split_keeps_every_row_once(spark):
    df = spark.range(1000).withColumn("t", F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")))
    rules = [("short", F.length("t") < 5), ("long", F.length("t") > 40)]
    accepted, quarantine = v.split_valid(df, rules)
    assert accepted.count() + quarantine.count() == 1000
    assert accepted.join(quarantine, "id").count() == 0
    assert v.first_error(df, rules).filter(F.col("error").isNotNull()).count() == quarantine.count()


def test_quality_boundaries(spark):
    rows = [("good text", 0.85), ("good text", 0.849), ("   ", 0.99), ("?#@$ what", 0.99), ("a" * 9 + "?", 0.99), (None, 0.99), ("x", None)]
    got = v.ocr_quality(spark.createDataFrame(rows, "t string, c double"), "t", "c").collect()
    assert [r.passed for r in got] == [True, False, False, False, True, False, False]


def test_coerce_numeric(spark):
    df = spark.createDataFrame([("1", "x", None), ("2.5", "3", None), (None, "4", None)], "a string, b string, c string")
    assert dict(v.coerce_numeric(df, ["a", "b", "c"]).dtypes) == {"a": "double", "b": "string", "c": "double"}


def test_registries(spark):
    reg = registry.Registry("thing")
    reg.add("one", 1)
    assert reg.get("one") == 1
    with pytest.raises(ValueError):
        reg.add("one", 2)
    with pytest.raises(ValueError):
        reg.add("bad name", 2)
    with pytest.raises(KeyError):
        reg.get("two")
    with pytest.raises(ValueError):
        registry.register_metric("h", "histogram")


def test_apply_writes_in_order(spark):
    current = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    ops = spark.createDataFrame(
        [("create", 1, 1, "x"), ("delete", 2, 2, None), ("create", 3, 2, "y"), ("update", 4, 2, "z"), ("update", 5, 9, "n"), ("delete", 6, 1, None), ("delete", 7, 1, None)],
        "op string, seq int, id int, v string",
    )
    state, rejected = catalog.apply_writes(current, ops)
    assert sorted(map(tuple, state.collect())) == [(2, "z")]
    assert sorted((r.seq, r.reason) for r in rejected.collect()) == [(1, "already exists"), (5, "not found"), (7, "not found")]


def test_members_of_a_configuration_are_read_once(spark):
    """Rules over members read once say what rules over the configuration say."""
    texts = [
        "{}", "null", "[1]", "not json",
        '{"source_path":"/in/a.PDF","output_format":"JSON","languages":["eng","x"],"processing_options":{"dpi":300,"page_segmentation_mode":14}}',
        '{"source_path":7,"output_format":null,"processing_options":{"dpi":"300","ocr_engine_mode":1.5},"timeout_seconds":"x","size_bytes":0}',
        '{"source_path":"/a/../b.gif","extraction_type":"form","quality_threshold":1.5,"max_memory_mb":0,"batch_size":true,"timeout_seconds":5000}',
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, j string").select("id", v.config_variant(F.col("j")).alias("c"))
    for rules_of in (v.ocr_config_rules, v.task_rules, lambda c: v.scrape_config_rules(c, check_patterns=False)):
        plain = {r.id: r.errors for r in v.validate(df, rules_of(F.col("c"))).collect()}
        members = v.Members(F.col("c"))
        rules = rules_of(members)
        read = members.read(df)
        assert {r.id: r.errors for r in v.validate(read, rules).collect()} == plain
        reads = read.columns[2:]
        assert reads and len(set(reads)) == len(reads)
        plan = v.rule_counts(read, rules)._jdf.queryExecution().optimizedPlan().toString()
        asked = sum(name.startswith("__kind") for name in reads)
        assert plan.count("schemaOfVariant(") == asked


def test_apply_writes_over_many_tasks(spark, monkeypatch):
    """Beyond ``TASK_ROWS`` rows a task the work is dealt over more; repeated and null keys are as before."""
    import random

    from gleanery.plans import slices

    r = random.Random(3)
    current = [(k, f"old{k}") for k in range(0, 30, 2)] + [(4, "twice"), (None, "none"), (None, "none")]
    keys = [*range(30), None] + [5] * 40
    ops = [(r.choice(["create", "update", "delete", "merge"]), i, r.choice(keys), f"v{i}") for i in range(600)]
    r.shuffle(ops)
    here, left, rejected = {k for k, _ in current if k is not None}, {}, []
    for op, seq, key, value in sorted(ops, key=lambda o: o[1]):
        reason = {"create": "already exists" if key in here else None, "update": None if key in here else "not found", "delete": None if key in here else "not found"}.get(op, "unknown operation")
        if reason:
            rejected += [(seq, reason)] * (max(1, sum(k == key for k, _ in current)) if key is not None else 1)
        else:
            left[key] = (op, value)
        here = here | {key} if op == "create" else here - {key} if op == "delete" else here
    want = [(k, x) for k, x in current if k is None or k not in left] + [(k, x) for k, (op, x) in left.items() if op != "delete"]
    for rows in (slices.TASK_ROWS, 20):
        monkeypatch.setattr(slices, "TASK_ROWS", rows)
        state, refused = catalog.apply_writes(spark.createDataFrame(current, "id int, v string"), spark.createDataFrame(ops, "op string, seq int, id int, v string"))
        assert sorted(map(str, map(tuple, state.collect()))) == sorted(map(str, want))
        assert sorted((x.seq, x.reason) for x in refused.collect()) == sorted(rejected)
    plan = state._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "REPARTITION_BY_NUM" in plan


def test_page_has_its_items_in_order_and_totals_past_the_end(spark):
    df = spark.range(500).select(((F.col("id") * 7919) % 500).alias("k"), "id")
    page = catalog.page_offset(df, ["k"], 4, 100).first()
    assert [r.k for r in page["items"]] == list(range(300, 400))
    past = catalog.page_offset(df, ["k"], 9, 100).first()
    assert past["items"] == [] and (past.total_items, past.total_pages, past.has_next, past.has_prev) == (500, 5, False, True)


def test_create_refuses_repeated_keys(spark):
    current = spark.createDataFrame([(1, "a")], "id int, v string")
    rows = spark.createDataFrame([(1, "x"), (2, "b"), (2, "c")], "id int, v string")
    state, refused = catalog.create_new(current, rows)
    assert sorted(map(tuple, state.collect())) == [(1, "a"), (2, "b")]
    assert sorted(map(tuple, refused.collect())) == [(1, "x"), (2, "c")]


def test_a_type_suffix_is_no_number(spark):
    df = spark.createDataFrame([("3D", "3"), ("5f", " -4.5e1 ")], "a string, b string")
    got = v.coerce_numeric(df, ["a", "b"])
    assert got.schema["a"].dataType.simpleString() == "string" and [r.b for r in got.collect()] == [3.0, -45.0]


def test_keyset_pages_make_up_the_whole(spark):
    df = spark.range(95).select((F.col("id") % 10).alias("k"), "id")
    after, seen = None, []
    while True:
        page = catalog.page_keyset(df, "k", "id", after, 10).collect()
        seen += [(r.k, r.id) for r in page]
        if not page or page[0].next_id is None:
            break
        after = (page[0].next_key, page[0].next_id)
    assert seen == sorted((i % 10, i) for i in range(95))


def test_page_limits(spark):
    tasks = spark.range(1).select("id", F.lit("x").alias("status"), F.lit(datetime(2024, 1, 1)).alias("created_at"))
    for size in (0, 1001):
        with pytest.raises(ValueError):
            catalog.list_by_status(tasks, "x", size)
        with pytest.raises(ValueError):
            catalog.page_offset(tasks, ["id"], 1, size)
    with pytest.raises(ValueError):
        catalog.page_offset(tasks, ["id"], 0)
