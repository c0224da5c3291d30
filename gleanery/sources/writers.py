"""Batch and streaming sinks."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.values import moment, stable_id

# The columns of a task listing.
LISTING_COLUMNS = ("id", "type", "status", "created_at")


def write_objects(df: DataFrame, root: str, ts_col: str, fmt: str = "parquet") -> None:
    """Rows under ``y=YYYY/m=MM/d=DD``."""
    dated = df.withColumns({"y": F.date_format(ts_col, "yyyy"), "m": F.date_format(ts_col, "MM"), "d": F.date_format(ts_col, "dd")})
    dated.write.mode("errorifexists").partitionBy("y", "m", "d").format(fmt).save(root)


def partition_key(ts_col: str):
    return F.date_format(ts_col, "yyyyMM")


def write_by_month(df: DataFrame, path: str, ts_col: str) -> None:
    """Parquet partitioned by ``partition_key = yyyyMM``; readers prune on it."""
    df.withColumn("partition_key", partition_key(ts_col)).write.mode("errorifexists").partitionBy("partition_key").parquet(path)


def read_month(spark: SparkSession, path: str, month: str | None = None) -> DataFrame:
    """One month of a :func:`write_by_month` table, or all."""
    table = spark.read.option("basePath", path).parquet(path)
    return table if month is None else table.filter(F.col("partition_key").cast("string") == month)


def stored_content(df: DataFrame, object_id: str, kind: str, root: str, processed_at: datetime, rules: str = "{}") -> DataFrame:
    """Content rows: JSON body, storage path, and what the manifest needs to know."""
    body = F.to_json(F.struct(*[c for c in df.columns if c != kind]))
    content_type = F.when(F.col(kind) == "table", F.lit("application/json")).otherwise(F.lit("text/plain"))
    tables = F.col("table_count") if "table_count" in df.columns else F.lit(None).cast("int")
    identity = stable_id(F.col(kind), F.col(object_id))
    return df.select(
        identity.alias("id"),
        body.alias("content"),
        F.concat(F.lit(root.rstrip("/") + "/"), F.date_format(moment(processed_at), "yyyy/MM/dd"), F.lit("/"), identity).alias("storage_path"),
        content_type.alias("content_type"),
        moment(processed_at).alias("processed_at"),
        F.col(kind).alias("pipeline_type"),
        tables.alias("table_count"),
        F.lit(rules).alias("validation_rules"),
    )


def store_results(df: DataFrame, content_path: str, catalog_path: str, object_id: str, kind: str, processed_at: datetime, rules: str = "{}") -> None:
    """Write content once, then the manifest from the written files.

    The manifest is read back from the columns stored with the content, so the
    expensive frame runs once and a lost executor costs no second evaluation.
    """
    spark = df.sparkSession
    stored_content(df, object_id, kind, content_path, processed_at, rules).write.mode("errorifexists").parquet(content_path)
    manifest = spark.read.parquet(content_path).drop("content")
    manifest.write.mode("errorifexists").parquet(catalog_path)


def write_with_sidecar(df: DataFrame, root: str, name: str, content: str, metadata: str) -> int:
    """One file per object and a ``<name>.meta`` JSON beside it; returns the objects written.

    Tasks write to the shared file system ``root`` names. A retried task writes
    the same files again. The sidecar goes last, so an object without one was
    never finished and ``read_with_sidecar`` leaves it out.
    """
    body = df.select(
        F.col(name).cast("string").alias("name"), F.col(content).cast("binary").alias("content"), F.to_json(metadata).alias("meta")
    )

    def store(batches):
        import pandas as pd
        from pyarrow import fs

        target, base = fs.FileSystem.from_uri(root)
        made = set()
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                path = f"{base}/{row.name}"
                folder = path.rsplit("/", 1)[0]
                if folder not in made:
                    target.create_dir(folder, recursive=True)
                    made.add(folder)
                for suffix, data in (("", bytes(row.content)), (".meta", row.meta.encode())):
                    with target.open_output_stream(path + suffix) as out:
                        out.write(data)
            yield pd.DataFrame({"written": [len(pdf)]})

    return body.mapInPandas(store, "written long").agg(F.coalesce(F.sum("written"), F.lit(0))).first()[0]


def export_listing(df: DataFrame, fmt: str, path: str) -> None:
    """The fixed listing columns as JSON or CSV files."""
    listing = df.select(*LISTING_COLUMNS)
    if fmt == "json":
        listing.write.mode("errorifexists").json(path)
    elif fmt == "csv":
        listing.write.mode("errorifexists").option("header", True).csv(path)
    else:
        raise ValueError("listing format must be json or csv")


def write_log_stream(df: DataFrame, path: str, checkpoint: str, every: str | None = "10 seconds"):
    """Masked log entries as JSON. The trigger interval takes the buffer's place.

    ``every=None`` handles what is there and stops.
    """
    writer = df.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
