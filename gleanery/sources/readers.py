"""Batch and streaming sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.sources.listing import listing, with_content

CORRUPT = "_corrupt_record"
DEFAULT_CONTENT_TYPE = "application/octet-stream"
MAX_BATCH_FILES = 100

TASK_MESSAGE = T.StructType(
    [
        T.StructField("task_id", T.StringType()),
        T.StructField("task_type", T.StringType()),
        T.StructField("scheduled_at", T.TimestampType()),
        T.StructField("operation", T.StringType()),
        T.StructField("retry_count", T.IntegerType()),
        T.StructField("error", T.StringType()),
    ]
)


def read_landing(spark: SparkSession, path: str, fmt: str, schema: T.StructType) -> DataFrame:
    """JSON, CSV or Parquet landing data. Malformed text rows stay, in ``_corrupt_record``."""
    if fmt == "parquet":
        return spark.read.schema(schema).parquet(path)
    if fmt not in ("json", "csv"):
        raise ValueError("landing format must be json, csv or parquet")
    reader = (
        spark.read.schema(T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())]))
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
    )
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.json(path)


def list_objects(spark: SparkSession, root: str, prefix: str = "", suffixes: Sequence[str] = (), recursive: bool = True, max_results: int | None = None) -> DataFrame:
    """``(name, size_bytes, content_suffix, modified_at)``; file contents are never read.

    Empty objects and names of any characters are listed; see :mod:`gleanery.sources.listing`.
    """
    files = listing(spark, root, prefix, recursive).select(
        "name", "size_bytes", F.lower(F.regexp_extract("name", r"[.][^./]*$", 0)).alias("content_suffix"), "modified_at"
    )
    if suffixes:
        files = files.filter(F.col("content_suffix").isin(*[s.lower() for s in suffixes]))
    return files.orderBy("name").limit(max_results) if max_results is not None else files


def list_batch(spark: SparkSession, root: str, suffixes: Sequence[str], max_files: int = MAX_BATCH_FILES, recursive: bool = True) -> DataFrame:
    """The files of one recognition batch; more than ``max_files`` is an error."""
    files = list_objects(spark, root, suffixes=suffixes, recursive=recursive)
    found = files.limit(max_files + 1).count()
    if found > max_files:
        raise ValueError(f"batch holds more than {max_files} files")
    return files


def read_with_sidecar(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """Objects paired with their ``<name>.meta`` JSON.

    Hidden files go, and so do objects whose sidecar is missing or malformed.
    """
    files = listing(spark, root)
    is_meta = F.col("name").endswith(".meta")
    sidecars = with_content(files.filter(is_meta), root).select(
        F.expr("left(name, length(name) - 5)").alias("name"),
        F.from_json(F.col("content").cast("string"), "map<string,string>").alias("metadata"),
    )
    objects = files.filter(~is_meta)
    paired = objects.join(sidecars.filter(F.col("metadata").isNotNull()), "name").select("name", "size_bytes", "modified_at", "metadata")
    paired = with_content(paired, root) if content else paired
    kind = F.coalesce(F.element_at("metadata", "content_type"), F.lit(DEFAULT_CONTENT_TYPE))
    return paired.withColumn("content_type", kind)


def read_task_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Queue messages from JSON files as a stream."""
    return spark.readStream.schema(TASK_MESSAGE).option("maxFilesPerTrigger", max_files).json(path)


def read_task_topic(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """The same messages from Kafka (needs the connector package on the cluster)."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return raw.select(F.from_json(F.col("value").cast("string"), TASK_MESSAGE).alias("m")).select("m.*")
