"""Small helpers the corpus operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: the six ASCII characters, nothing wider.
SPACE = r"[\x20\x09-\x0D]+"

#: Rows in one Arrow batch. Texts are taken whole, so batches are kept short.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession) -> None:
    """Bound the rows, and so the bytes, that one Python batch holds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def filtered_scans(spark: SparkSession) -> None:
    """Let Spark filter any scan by the keys it is to be joined with, before it is shuffled.

    This is Spark's own runtime Bloom filter, of bounded size whatever it is built from.
    By default it looks at large scans and small sets of keys only, so that a job moves
    more of its texts the larger it is.
    """
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.enabled", "true")
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "1")
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold", "100g")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, whatever its other columns are called."""
    taken = {c.lower() for c in df.columns}
    return stem if stem not in taken else f"{stem}_{uuid.uuid4().hex[:8]}"


def required(df: DataFrame, *names: str) -> None:
    """Raise when a column is missing or its name is ambiguous."""
    for name in names:
        found = [c for c in df.columns if c.lower() == name.lower()]
        if found != [name]:
            raise ValueError(f"need exactly one column {name!r}, found {len(found)} in {df.columns}")


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns whose names an operator is about to add."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def whole(text: str) -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def last(value: Column) -> Column:
    """Order key that puts nulls after every value."""
    return F.struct(value.isNull().alias("none"), value.alias("value"))


def least_first(df: DataFrame, keys: list[str], *carried: Column) -> DataFrame:
    """The smallest struct of ``carried`` per key."""
    return df.groupBy(*keys).agg(F.min(F.struct(*carried)).alias("first"))
