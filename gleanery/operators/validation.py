"""Record validation: named rules, rejection reasons, accepted/quarantine split.

A rule is ``(name, Column)`` where the Column is true for a *bad* row. All
broken rules of a row are reported together; :func:`first_error` keeps only the
first, for callers that stop there. Configurations are VARIANT columns (see
``parse_json``), so that a value's JSON type can be checked.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions import text as tx
from gleanery.functions.values import as_number, is_uuid, parse_iso
from gleanery.session import scratch_path, stored

Rule = tuple[str, Column]

# Task vocabulary and the legal status moves.
TASK_TYPES = ("scrape", "ocr")
TRANSITIONS = {
    "pending": ("running", "cancelled"),
    "running": ("completed", "failed"),
    "failed": ("pending",),
    "cancelled": ("pending",),
    "completed": (),
}

# What JSON values are called, by the first letters of their VARIANT type.
JSON_KINDS = {
    "STR": "string",
    "BIG": "int",
    "DEC": "number",
    "DOU": "number",
    "BOO": "bool",
    "VOI": "null",
    "ARR": "array",
    "OBJ": "object",
}

# Recognition settings.
OCR_SUFFIXES = (".pdf", ".png", ".jpg", ".jpeg", ".tiff")
OCR_OUTPUTS = ("txt", "json", "xml", "hocr")
OCR_EXTRACTIONS = ("text", "table", "mixed")
OCR_OPTION_DEFAULTS = {"dpi": "300", "page_segmentation_mode": "3", "ocr_engine_mode": "3", "language": "eng"}
MAX_OBJECT_BYTES = 100 * 1024 * 1024
CONFIDENCE_THRESHOLDS = {"text": 0.85, "table": 0.90}
FINAL_CONFIDENCE = 0.98


# --- running rules ---------------------------------------------------------


def errors_of(rules: Sequence[Rule]) -> Column:
    """Names of the broken rules, in rule order."""
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules]))


def validate(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    return df.withColumn("errors", errors_of(rules))


def first_error(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The first broken rule, or null."""
    return df.withColumn("error", F.coalesce(*[F.when(bad, F.lit(name)) for name, bad in rules]))


def split_valid(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantine). Quarantined rows carry status, first error and all reasons.

    The input runs once: the judged rows are written under their verdict, and each half
    reads its own folder.
    """
    path = scratch_path(df.sparkSession, "verdicts")
    judged = validate(df, rules).withColumn("__rejected", (F.size("errors") > 0).cast("int"))
    judged.write.partitionBy("__rejected").parquet(path)
    checked = df.sparkSession.read.schema(judged.schema).parquet(path)
    accepted = checked.filter("__rejected = 0").select(*df.columns)
    quarantine = checked.filter("__rejected = 1").select(
        *df.columns,
        F.lit("failed").alias("status"),
        F.element_at("errors", 1).alias("error"),
        F.col("errors").alias("details"),
    )
    return accepted, quarantine


def rule_counts(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows breaking each rule: one pass of conditional counts, one row per rule."""
    counts = df.agg(*[F.count_if(bad).alias(name) for name, bad in rules])
    names = [name for name, _ in rules]
    return counts.unpivot([], [F.col(f"`{n}`") for n in names], "rule", "bad_rows")


# --- JSON helpers ----------------------------------------------------------


def config_variant(json_text: Column) -> Column:
    """JSON text as VARIANT, null when it does not parse."""
    return F.try_parse_json(json_text)


class Members:
    """Members of a VARIANT column as columns of their own, each read once however many rules ask.

    Rule sets take it in place of the column; ``read`` then adds what they asked for.
    """

    def __init__(self, config: Column):
        self.config = config
        self._reads: dict[str, Column] = {}

    def column(self, what: str, path: str, reading: Column) -> Column:
        name = f"__{what} {path}"
        self._reads[name] = reading
        return F.col(f"`{name}`")

    def read(self, df: DataFrame) -> DataFrame:
        return df.select("*", *[reading.alias(name) for name, reading in self._reads.items()])


Config = Column | Members


def json_get(config: Config, path: str, kind: str) -> Column:
    """The member at ``path`` as ``kind``, null where it does not convert."""
    if isinstance(config, Members):
        return config.column(kind, path, json_get(config.config, path, kind))
    return F.try_variant_get(config, path, kind)


def json_kind(config: Config, path: str) -> Column:
    """'string', 'int', 'number', 'bool', 'array', 'object', 'null', or 'missing'."""
    if isinstance(config, Members):
        return config.column("kind", path, json_kind(config.config, path))
    schema = F.schema_of_variant(F.try_variant_get(config, path, "variant"))
    names = F.create_map(*[F.lit(x) for item in JSON_KINDS.items() for x in item])
    return F.coalesce(F.element_at(names, F.substring(schema, 1, 3)), F.lit("missing"))


def json_text(config: Config, path: str) -> Column:
    """The string at ``path``, null for any other kind."""
    return F.when(json_kind(config, path) == "string", json_get(config, path, "string"))


def json_number(config: Config, path: str) -> Column:
    """The number at ``path``, null for any other kind."""
    return F.when(json_kind(config, path).isin("int", "number"), json_get(config, path, "double"))


def _given(config: Config, path: str) -> Column:
    return json_kind(config, path) != "missing"


def _bad(condition: Column) -> Column:
    """An unknown answer is a broken rule."""
    return ~F.coalesce(condition, F.lit(False))


def _outside(config: Config, path: str, low: float, high: float | None = None) -> Column:
    """Present, and not a number within [low, high]."""
    kind = json_kind(config, path)
    number = json_get(config, path, "double")
    inside = number >= low if high is None else number.between(low, high)
    return F.when(kind.isin("int", "number"), ~inside).otherwise(_given(config, path))


# --- rule sets -------------------------------------------------------------


def content_rules(
    df: DataFrame,
    min_len: int = 1,
    max_len: int = 1_000_000,
    required: Sequence[str] = (),
    max_field: int | None = 10_000,
) -> list[Rule]:
    """Record-level content limits. The extractor uses max_len 100000 and no field limit."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    length = F.length(F.to_json(F.struct(*[F.col(c) for c in df.columns])))
    empty = F.lit(True)
    for name in df.columns:
        empty = empty & F.col(name).isNull()
    rules = [("content_empty", empty)]
    rules += [(f"missing_{name}", F.col(name).isNull()) for name in required]
    rules += [("content_too_short", length < min_len), ("content_too_long", length > max_len)]
    if max_field is not None:
        rules += [(f"{name}_too_long", F.length(name) > max_field) for name in strings]
    return rules


def field_type_rules(types: Mapping[str, str]) -> list[Rule]:
    """Text columns whose non-null value does not read as the declared type."""
    read = lambda name, kind: as_number(F.col(name)) if kind in ("double", "float") else F.col(name).try_cast(kind)
    return [(f"{name}_not_{kind}", F.col(name).isNotNull() & read(name, kind).isNull()) for name, kind in types.items()]


def task_rules(config: Config) -> list[Rule]:
    """Task configuration: type, source, parameters, and what each type needs."""
    kind = json_text(config, "$.type")
    params = json_kind(config, "$.parameters") == "object"

    def lacks(task_type: str, *names: str) -> Column:
        missing = F.lit(False)
        for name in names:
            missing = missing | ~_given(config, f"$.parameters.{name}")
        return F.coalesce(kind == task_type, F.lit(False)) & params & missing

    absent = F.lit(False)
    for name in ("type", "source", "parameters"):
        absent = absent | ~_given(config, f"$.{name}")
    return [
        ("missing_fields", absent),
        ("invalid_type", _bad(kind.isin(*TASK_TYPES))),
        ("invalid_source", tx.is_blank(json_text(config, "$.source"))),
        ("parameters_not_object", ~params),
        ("scrape_parameters", lacks("scrape", "url", "selectors")),
        ("ocr_parameters", lacks("ocr", "file_path", "language")),
    ]


def task_create_rules(kind: Column, config: Config, tags: Column, description: Column) -> list[Rule]:
    """A creation request: source form per type, tag and description limits."""
    source = json_text(config, "$.source")
    tag_too_long = F.exists(F.map_entries(tags), lambda e: (F.length(e["key"]) > 50) | (F.length(e["value"]) > 100))
    return [
        ("invalid_type", _bad(kind.isin(*TASK_TYPES))),
        ("source_missing", ~_given(config, "$.source")),
        ("scrape_source", (kind == "scrape") & _bad(source.rlike("^https?://"))),
        ("ocr_source", (kind == "ocr") & _bad(source.rlike(r"[.](pdf|png|jpg|jpeg)$"))),
        ("too_many_tags", F.size(tags) > 10),
        ("tag_too_long", tag_too_long),
        ("description_too_long", F.length(description) > 1000),
    ]


def compiles(pattern: str) -> bool:
    """Whether a configured url pattern is a regular expression."""
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def _bad_patterns(config: Config) -> Column:
    """True when some allowed pattern does not compile; only rows with patterns reach Python."""
    def any_bad(batches: pa.Array) -> pa.Array:
        return pa.array([p is not None and not all(compiles(x) for x in p) for p in batches.to_pylist()], pa.bool_())

    patterns = json_get(config, "$.security.allowed_patterns", "array<string>")
    return F.arrow_udf(any_bad, T.BooleanType())(F.when(F.size(patterns) > 0, patterns))


def scrape_config_rules(config: Config, check_patterns: bool = True) -> list[Rule]:
    """Scraping settings: domains, rates, concurrency, time limit, depth, patterns."""
    domains = json_get(config, "$.allowed_domains", "array<string>")
    rules = [
        ("source", _bad(json_text(config, "$.source").rlike("^https?://"))),
        ("allowed_domains", _bad(F.size(domains) >= 1)),
        ("requests_per_second", _outside(config, "$.rate_limit.requests_per_second", 0.1, 100)),
        ("burst_size", _outside(config, "$.rate_limit.burst_size", 1)),
        ("concurrent_requests", _outside(config, "$.performance.concurrent_requests", 1, 32)),
        ("timeout_seconds", _outside(config, "$.performance.timeout_seconds", 1, 300)),
        ("depth", _given(config, "$.depth") & (_bad(json_kind(config, "$.depth") == "int") | _outside(config, "$.depth", 0))),
        ("rate", json_kind(config, "$.rate_limit").isin("int", "number") & _bad(json_number(config, "$.rate_limit") > 0)),
    ]
    if check_patterns:
        rules.append(("allowed_patterns", _bad_patterns(config)))
    return rules


def ocr_config_rules(config: Config) -> list[Rule]:
    """Recognition settings. Absent optional settings take their defaults and pass."""
    path = json_text(config, "$.source_path")
    languages = json_get(config, "$.languages", "array<string>")
    suffix = F.lower(F.regexp_extract(path, r"[.][^./]*$", 0))
    threshold = json_number(config, "$.quality_threshold")

    def option(name: str, low: int, high: int) -> Rule:
        at = f"$.processing_options.{name}"
        wrong_kind = _given(config, at) & (json_kind(config, at) != "int")
        return name, wrong_kind | _outside(config, at, low, high)

    return [
        ("source_format", _bad(suffix.isin(*OCR_SUFFIXES))),
        ("path_traversal", F.coalesce(F.array_contains(F.split(path, "/"), ".."), F.lit(False))),
        ("output_format", _bad(F.lower(json_text(config, "$.output_format")).isin(*OCR_OUTPUTS))),
        ("languages", F.coalesce(F.exists(languages, lambda x: F.length(x) != 3), F.lit(False))),
        option("dpi", 72, 1200),
        option("page_segmentation_mode", 0, 13),
        option("ocr_engine_mode", 0, 3),
        ("timeout_seconds", _outside(config, "$.timeout_seconds", 1, 3600)),
        ("size_bytes", _outside(config, "$.size_bytes", 1, MAX_OBJECT_BYTES)),
        ("extraction_type", _given(config, "$.extraction_type") & _bad(json_text(config, "$.extraction_type").isin(*OCR_EXTRACTIONS))),
        ("quality_threshold", _given(config, "$.quality_threshold") & _bad((threshold > 0) & (threshold <= 1))),
        ("max_memory_mb", _given(config, "$.max_memory_mb") & _bad(json_number(config, "$.max_memory_mb") > 0)),
        ("batch_size", _given(config, "$.batch_size") & _bad(json_number(config, "$.batch_size") > 0)),
    ]


def ocr_defaults(options: Column, languages: Column) -> tuple[Column, Column]:
    """(options merged over the defaults, lower-cased languages defaulting to eng)."""
    pairs = [F.lit(x) for item in OCR_OPTION_DEFAULTS.items() for x in item]
    merged = F.map_concat(F.create_map(*pairs), F.coalesce(options, F.create_map().cast("map<string,string>")))
    chosen = F.when(F.size(languages) > 0, F.transform(languages, F.lower)).otherwise(F.array(F.lit("eng")))
    return merged, chosen


def execution_state_rules(status: Column, end_time: Column, result: Column, error: Column) -> list[Rule]:
    """What a completed or failed execution must and must not carry."""
    has_result = F.coalesce(F.length(result) > 0, F.lit(False))
    has_error = F.coalesce(F.length(error) > 0, F.lit(False))
    done, failed = status == "completed", status == "failed"
    return [
        ("completed_without_end", done & end_time.isNull()),
        ("completed_without_result", done & ~has_result),
        ("completed_with_error", done & has_error),
        ("failed_without_end", failed & end_time.isNull()),
        ("failed_without_error", failed & ~has_error),
        ("failed_with_result", failed & has_result),
    ]


def object_rules(path: Column, content_type: Column, size: Column, required: Sequence[Column] = ()) -> list[Rule]:
    """Stored objects: gs:// path with a proper bucket, content type, positive size."""
    parts = F.split(F.regexp_replace(path, "gs://", ""), "/")
    bucket = parts[0]
    missing = F.lit(False)
    for column in required:
        missing = missing | column.isNull()
    return [
        ("missing_field", missing),
        ("path_scheme", _bad(path.startswith("gs://"))),
        ("path_parts", _bad(F.size(parts) >= 2)),
        ("bucket_length", _bad(F.length(bucket).between(3, 63))),
        ("bucket_case", _bad((bucket == F.lower(bucket)) & (bucket != F.upper(bucket)))),
        ("content_type", _bad(content_type.contains("/"))),
        ("size", size.isNotNull() & (size <= 0)),
    ]


def metadata_type_rules(metadata: T.StructType, prefix: str = "metadata") -> list[str]:
    """Paths in a metadata schema whose type a record may not hold (checked on the schema)."""
    allowed = (T.StringType, T.IntegralType, T.FloatType, T.DoubleType, T.BooleanType, T.TimestampType, T.TimestampNTZType)
    bad: list[str] = []

    def walk(kind: T.DataType, path: str) -> None:
        if isinstance(kind, T.StructType):
            for field in kind.fields:
                walk(field.dataType, f"{path}.{field.name}")
        elif isinstance(kind, T.ArrayType):
            walk(kind.elementType, f"{path}[]")
        elif isinstance(kind, T.MapType):
            walk(kind.valueType, f"{path}{{}}")
        elif not isinstance(kind, allowed):
            bad.append(path)

    walk(metadata, prefix)
    return bad


def metadata_kinds(df: DataFrame, metadata: str) -> DataFrame:
    """The merged type of a VARIANT metadata column, for dynamic bodies."""
    return df.agg(F.schema_of_variant_agg(F.col(metadata)).alias("metadata_schema"))


# Types of a VARIANT that a metadata value may have, besides nested ones.
METADATA_KINDS = ("STRING", "BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "BOOLEAN", "TIMESTAMP", "TIMESTAMP_NTZ")


def metadata_values(df: DataFrame, key: str, metadata: str) -> DataFrame:
    """(key, path, kind) of every value of a VARIANT column, nested ones too.

    Paths are ``metadata.a.b`` for fields and end in ``[]`` for items. Every step of the
    recursion opens the nested values of all rows by one level. Null metadata has no values.
    """
    rows = df.select(F.col(key).alias("id"), F.col(metadata).alias("v")).filter(F.col(metadata).isNotNull())
    spark = df.sparkSession
    # Spark's limit on the rows of a recursion guards against endless ones; this one ends.
    before = spark.conf.get("spark.sql.cteRecursionRowLimit", None)
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    try:
        walked = spark.sql(
            f"""WITH RECURSIVE walk AS (
                  SELECT id, '{metadata}' AS path, v, schema_of_variant(v) AS kind FROM {{rows}}
                  UNION ALL
                  SELECT id, CASE WHEN item.key IS NULL THEN path || '[]' ELSE path || '.' || item.key END, item.value, schema_of_variant(item.value)
                  FROM walk, LATERAL variant_explode(v) item WHERE kind LIKE 'OBJECT%' OR kind LIKE 'ARRAY%')
                SELECT id, path, regexp_extract(kind, '^[A-Z_]+', 0) AS kind FROM walk""",
            rows=rows,
        )
        # Written while the limit is off.
        return stored(walked.withColumnRenamed("id", key), "metadata_values")
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit") if before is None else spark.conf.set("spark.sql.cteRecursionRowLimit", before)


def metadata_type_violations(df: DataFrame, key: str, metadata: str) -> DataFrame:
    """(key, path, kind, values) of metadata values a record may not hold: null, binary, dates and others.

    Metadata that is not an object is one at its root. Equal paths of a row are counted.
    """
    values = metadata_values(df, key, metadata)
    root = F.col("path") == metadata
    bad = F.when(root, F.col("kind") != "OBJECT").otherwise(~F.col("kind").isin("OBJECT", "ARRAY", *METADATA_KINDS))
    return values.filter(bad).groupBy(key, "path", "kind").agg(F.count("*").alias("values"))


def source_rules(name: Column, kind: Column, credentials: Column, configuration: Column, metadata: Column) -> list[Rule]:
    """Data sources: the keys each type needs in its maps."""

    def lacks(entries: Column, key: str) -> Column:
        return ~F.coalesce(F.map_contains_key(entries, F.lit(key)), F.lit(False))

    scrape, ocr = kind == "scrape", kind == "ocr"
    return [
        ("type", _bad(kind.isin(*TASK_TYPES))),
        ("name", _bad(F.length(name) > 0)),
        ("credentials", credentials.isNull() | (scrape & lacks(credentials, "api_key")) | (ocr & lacks(credentials, "service_account"))),
        ("configuration", configuration.isNull() | (scrape & lacks(configuration, "base_url")) | (ocr & lacks(configuration, "output_format"))),
        ("metadata", lacks(metadata, "content_type")),
    ]


def id_time_rules(ids: Mapping[str, Column], times: Mapping[str, Column]) -> list[Rule]:
    """UUID text and ISO-8601 text; null fails both."""
    rules = [(f"{name}_not_uuid", ~is_uuid(c)) for name, c in ids.items()]
    return rules + [(f"{name}_not_iso_time", parse_iso(c).isNull()) for name, c in times.items()]


def config_section_check(df: DataFrame, config: str, environment: str) -> DataFrame:
    """One row per configuration section with a valid flag and message."""
    cfg = F.col(config)
    api = (json_kind(cfg, "$.api.timeout") == "int") & (json_kind(cfg, "$.api.rate_limit.max_requests") == "int")
    storage = (json_kind(cfg, "$.storage.encryption.enabled") == "bool") & (json_kind(cfg, "$.storage.retention.days") == "int")
    production = F.coalesce(F.try_variant_get(cfg, "$.storage.encryption.enabled", "boolean"), F.lit(False)) & (
        F.coalesce(json_number(cfg, "$.api.rate_limit.max_requests"), F.lit(0.0)) <= 1000
    )

    def section(name: str, valid: Column, message: str) -> Column:
        return F.struct(
            F.lit(name).alias("section"),
            valid.alias("valid"),
            F.when(valid, F.lit("Valid")).otherwise(F.lit("Invalid")).alias("status"),
            F.when(valid, F.lit("")).otherwise(F.lit(message)).alias("message"),
        )

    prod_row = section("Production", production, "Production security requirements not met")
    sections = F.array(
        section("API", api, "Invalid API configuration structure"),
        section("Storage", storage, "Invalid storage configuration structure"),
        F.when(F.col(environment) == "prod", prod_row),
    )
    others = [c for c in df.columns if c != config]
    return df.select(*others, F.inline(F.array_compact(sections)))


# --- quality ---------------------------------------------------------------


def ocr_quality(df: DataFrame, text: str, confidence: str, minimum: float = 0.85) -> DataFrame:
    """Add ``passed``: confident, non-blank, little noise, valid UTF-8."""
    t = F.col(text)
    good = (
        (F.coalesce(F.col(confidence), F.lit(0.0)) >= minimum)
        & ~tx.is_blank(t)
        & (tx.noise_ratio(t) <= 0.1)
        & F.is_valid_utf8(t)
    )
    return df.withColumn("passed", F.coalesce(good, F.lit(False)))


def quality_gate(df: DataFrame, kind: str, confidence: str, final: bool = False, thresholds: Mapping[str, float] = CONFIDENCE_THRESHOLDS) -> DataFrame:
    """Add the ``threshold`` for the row's type and ``passed``. ``final`` applies 0.98 to all."""
    if final:
        limit = F.lit(FINAL_CONFIDENCE)
    else:
        limit = F.lit(None).cast("double")
        for name, value in thresholds.items():
            limit = F.when(F.col(kind) == name, F.lit(float(value))).otherwise(limit)
    passed = F.coalesce(F.col(confidence) >= limit, F.lit(False))
    return df.withColumns({"threshold": limit, "passed": passed})


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Turn a text column into DOUBLE only if all its non-null values parse.

    The new schema depends on the data, so one aggregate row is fetched.
    """
    stays = df.agg(*[F.max(F.col(c).isNotNull() & as_number(F.col(c)).isNull()).alias(c) for c in columns]).first()
    return df.withColumns({c: as_number(F.col(c)) for c in columns if not stays[c]})
