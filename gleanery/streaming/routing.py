"""Retry and dead-letter routing of failed queue messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RETRIES = 3
BASE_DELAY = 60


def route_failures(failures: DataFrame, now: Column, max_retries: int = MAX_RETRIES, base: int = BASE_DELAY) -> DataFrame:
    """Add ``route`` (cancel, retry, dead_letter), the next count and its due time.

    ``failures(task_id, operation, retry_count, error)``. The delay doubles with
    every retry made so far.
    """
    count = F.coalesce(F.col("retry_count"), F.lit(0))
    route = (
        F.when(F.col("operation") == "cancel", F.lit("cancel"))
        .when(count < max_retries, F.lit("retry"))
        .otherwise(F.lit("dead_letter"))
    )
    delay = F.lit(base) * F.pow(F.lit(2.0), count)
    due = F.timestamp_micros(F.unix_micros(now.cast("timestamp")) + (delay * 1_000_000).cast("long"))
    retry = F.col("route") == "retry"
    return failures.withColumn("route", route).withColumns(
        {
            "scheduled_at": F.when(retry, due),
            "retry_count": F.when(retry, count + 1).otherwise(count),
            "operation": F.when(retry, F.lit("retry")).otherwise(F.col("operation")),
        }
    )


def write_routes(failures: DataFrame, path: str, checkpoint: str, max_retries: int = MAX_RETRIES, base: int = BASE_DELAY):
    """Stream routed messages, each batch written once into a folder per route: cancel, retry, dead_letter.

    A replayed batch overwrites its own ``batch_id`` folder, so a restart neither
    loses nor repeats a message. The due time counts from the ``failed_at`` of
    the message, not from the clock, for the same reason.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        routed = route_failures(batch, F.col("failed_at"), max_retries, base)
        routed.write.mode("overwrite").partitionBy("route").json(f"{path}/batch_id={batch_id}")

    return failures.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
