"""Content checksums and what they tell apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checksum_objects(df: DataFrame, content: str) -> DataFrame:
    """Add ``md5``, ``sha256`` and ``size_bytes`` of a binary or text column."""
    data = F.col(content).cast("binary")
    return df.withColumns({"md5": F.md5(data), "sha256": F.sha2(data, 256), "size_bytes": F.length(data)})


def verify_checksums(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """Ids whose sha256 differs between the sides or that only one side has."""
    a = left.select(key, F.col("sha256").alias("expected"))
    b = right.select(key, F.col("sha256").alias("actual"))
    problem = (
        F.when(F.col("actual").isNull(), F.lit("missing"))
        .when(F.col("expected").isNull(), F.lit("unexpected"))
        .when(F.col("expected") != F.col("actual"), F.lit("mismatch"))
    )
    return a.join(b, key, "full_outer").select(key, problem.alias("problem")).filter(F.col("problem").isNotNull())


def dedupe_first(df: DataFrame, keys: Sequence[Column], order: Sequence[str]) -> DataFrame:
    """The first row per key in ``order``, by map-side aggregation.

    A group of copies shrinks to one row in every map task, so a group holding
    much of the input never meets in one task.
    """
    texts = [k.cast("string") for k in keys]
    if len(texts) == 1:
        fingerprint = F.sha2(texts[0], 256)
    else:
        # With its length before it, a value cannot run into the next; null has none.
        marked = [F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
        fingerprint = F.sha2(F.concat(*marked), 256)
    row = F.struct(*df.columns)
    first = df.groupBy(fingerprint.alias("fingerprint")).agg(F.min_by(row, F.struct(*order)).alias("row"))
    return first.select("row.*", "fingerprint")


def latest_version(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row per object, by map-side aggregation."""
    rest = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return newest.select(*keys, "row.*")
