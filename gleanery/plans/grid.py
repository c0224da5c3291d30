"""Samples taken at any moment, brought to common evaluation ticks.

Ticks are the multiples of ``step`` seconds. What happened in ``(tick - step, tick]``
belongs to the tick. A key without a sample of its own at a tick still counts there as
long as its last one is not older than a lookback, so keys sampled at different moments
add up. The rows added to a key are bounded by the time it spans, and keys are cut into
slices of bounded size for it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.plans import slices

#: Seconds between two evaluations.
STEP = 15
#: Seconds for which a sample stands for its series.
LOOKBACK = 300


def tick_of(ts: str, step: int = STEP) -> Column:
    """The first tick at or after a moment, in epoch seconds."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return F.ceil(micros / F.lit(step * 1_000_000.0)) * F.lit(step)


def filled(ticks: DataFrame, keys: Sequence[str], step: int = STEP, lookback: int = LOOKBACK) -> DataFrame:
    """One row per key and ``tick`` in place of one per tick with samples, ``own`` for the latter.

    A row is repeated at the ticks after it, until the key's next row or for less than
    ``lookback`` seconds. ``ticks`` has one row per key and tick.
    """
    if lookback % step:
        raise ValueError("the lookback must be a multiple of the step")
    later = ticks.withColumn("__later", -F.col("tick"))
    # In descending order the row before is the next one in time.
    ordered = slices.by_range(later, keys, ["__later"])
    linked = slices.running(ordered, keys, ["__later"], {"__next": slices.Running("prev", F.col("tick"))})
    last = F.col("tick") + F.lit(lookback - step)
    until = F.least(F.coalesce(F.col("__next") - F.lit(step), last), last)
    rows = linked.withColumn("__at", F.explode(F.sequence("tick", until, F.lit(step).cast("long"))))
    return rows.withColumns({"own": F.col("__at") == F.col("tick"), "tick": F.col("__at")}).drop("__later", "__next", "__at")


def trailing_sums(df: DataFrame, keys: Sequence[str], ts: str, sums: Mapping[str, Column], seconds: int = LOOKBACK, step: int = STEP) -> DataFrame:
    """Sums over ``(tick - seconds, tick]`` at every tick with a row in that time."""
    per_tick = df.groupBy(*keys, tick_of(ts, step).alias("tick")).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    rows = filled(per_tick.filter(F.col("tick").isNotNull()), keys, step, seconds)
    values = {n: ("sum", F.when(F.col("own"), F.col(n))) for n in sums}
    return slices.trailing(rows, keys, "tick", seconds, values)


def last_values(samples: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str], values: Sequence[str], step: int = STEP, lookback: int = LOOKBACK) -> DataFrame:
    """(keys, tick, values): each key's last sample as of every tick, while it is fresh."""
    order = F.struct(F.col(ts).cast("timestamp").alias("at"), *tie)
    last = F.max_by(F.struct(*values), order)
    per_tick = samples.groupBy(*keys, tick_of(ts, step).alias("tick")).agg(last.alias("__last"))
    rows = filled(per_tick.filter(F.col("tick").isNotNull()), keys, step, lookback)
    return rows.select(*keys, "tick", "__last.*")
