"""Session settings the library relies on, and where to cut lineage."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join partition even when that costs another exchange later.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings. Shuffle partition counts stay the cluster's choice."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where the setting is absent, a folder beside the session's tables is used, as long as
    all tasks can see it: a local warehouse serves a local master only.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if re.match(r"(file:)?/", warehouse) and not sc.master.startswith(("local[", "local-cluster[")) and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = f"{warehouse.rstrip('/')}/intermediate"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` to reliable storage, so that lost executors cannot change it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, for intermediate tables."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Paths of the tables written inside ``tidied``.
_TABLES: ContextVar[list[str] | None] = ContextVar("tables", default=None)
#: Spark removes the shuffle files of a statement when it ends, instead of when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Tables that ``stored`` writes inside are packed more tightly, and removed at the end.

    Shuffle files go as soon as the table is written that they were for. What is to outlast
    the block is stored with ``keep``; nothing that leaves it may read another table of it.
    """
    before, token = spark.conf.get(_CLEANUP, None), _TABLES.set([])
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        for path in _TABLES.get():
            drop_scratch(spark, path)
        _TABLES.reset(token)
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` below the shared folder and read it back.

    Cuts lineage like a checkpoint, but is compressed, is read by column, and has a
    size that Spark knows when it plans a join.
    """
    path, tables = scratch_path(df.sparkSession, name), _TABLES.get()
    if tables is not None and not keep:
        tables.append(path)
    (df.write if tables is None else df.write.option("compression", "zstd")).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def done(*tables: DataFrame) -> None:
    """Remove tables written inside ``tidied`` that nothing will read again before its end."""
    made = _TABLES.get() or []
    if not made:
        return
    for df in tables:
        folders = {f.rsplit("/", 2)[1] for f in df.inputFiles()}
        for path in [x for x in made if x.rsplit("/", 1)[1] in folders]:
            drop_scratch(df.sparkSession, path)
            made.remove(path)


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Remove one folder made by ``scratch_path`` when nothing will read it again."""
    base = checkpoint_dir(spark).rstrip("/")
    if not path.startswith(f"{base}/") or ".." in path:
        raise ValueError(f"not a scratch folder: {path}")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
