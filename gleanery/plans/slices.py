"""Running windows that survive a hot key.

``Window.partitionBy(key)`` puts every row of a key into one task. Here keys are
first cut into order-preserving slices of bounded size; each slice is a window
partition of its own, and the state left by the earlier slices reaches it as one
extra *carry* row. Only per-slice summaries (one row per key and slice, built
with map-side aggregation) are ever ordered per key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.session import cut_lineage, stored

SLICE = "__slice"
_ROW = "__row"


#: Rows that a task of a window is to hold, where there are more than Spark's partitions make.
TASK_ROWS = 1_000_000


def parts_for(spark: SparkSession, rows: int) -> int | None:
    """Partitions for so many rows that are kept and sorted in memory; none where Spark's own
    number is enough, which adaptive execution may lower."""
    parts = -(-rows // TASK_ROWS)
    return parts if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def by_range(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], parts: int | None = None) -> DataFrame:
    """Cut at sampled boundaries of ``(keys, order)``, whatever their distribution.

    A slice of a key is its share of one range partition, so no slice is larger than a
    partition, however many rows a key or a moment has, and there are no more slices of
    a key than partitions. Boundaries come from a sample, so the result is written: a
    second evaluation could place a row elsewhere.
    """
    columns = [*keys, *order]
    ranged = df.repartitionByRange(parts, *columns) if parts else df.repartitionByRange(*columns)
    return stored(ranged.withColumn(SLICE, F.spark_partition_id().cast("long")), "slices")


_FOLDS = {"sum": F.sum, "max": F.max, "min": F.min}
#: The fold of two values, either of which may be null.
_BOTH = {"sum": lambda a, b: F.coalesce(a + b, a, b), "max": F.greatest, "min": F.least}


@dataclass(frozen=True)
class Running:
    """One running value.

    ``sum``, ``max`` and ``min`` include the current row. ``prev`` is the value on
    the row before, ``before`` the last non-null value on any earlier row.
    """

    kind: str
    value: Column

    def encoded(self) -> Column:
        # prev travels as a struct, so that a null value is still "the row before".
        return F.struct(self.value.alias("v")) if self.kind == "prev" else self.value

    def summarise(self, column: str, position: Column) -> Column:
        if self.kind in _FOLDS:
            return _FOLDS[self.kind](column)
        return F.max_by(F.col(column), F.when(F.col(column).isNotNull(), position))

    def over(self, column: str, window) -> Column:
        if self.kind in _FOLDS:
            return _FOLDS[self.kind](column).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        last = F.last(column, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, -1))
        return last["v"] if self.kind == "prev" else last

    def carried(self, column: str, window) -> Column:
        if self.kind in _FOLDS:
            return _FOLDS[self.kind](column).over(window)
        return F.last(column, ignorenulls=True).over(window)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Mapping[str, Running], keep_slices: bool = False, parts: int | None = None) -> DataFrame:
    """Add running values over each key in ``order`` to a sliced frame.

    ``order`` must be a total order within a key. With ``keep_slices`` the result is
    sliced alike, for further running values over the same keys and order. ``parts`` is the
    number of tasks that hold the slices, by default Spark's.
    """
    dealt = (lambda x: x.repartition(parts, *keys, SLICE)) if parts else (lambda x: x)
    inputs = {name: f"__in_{i}" for i, name in enumerate(values)}
    position = F.struct(*order)
    rows = df.select(
        "*",
        F.lit(1).alias(_ROW),
        *[v.encoded().alias(inputs[n]) for n, v in values.items()],
    )
    summary = dealt(rows.select(*dict.fromkeys([*keys, *order, SLICE, *inputs.values()]))).groupBy(*keys, SLICE).agg(
        *[v.summarise(inputs[n], position).alias(inputs[n]) for n, v in values.items()]
    )
    # With no key there is one row per slice, a number fixed by the slicing.
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        *keys,
        SLICE,
        F.lit(0).alias(_ROW),
        *[v.carried(inputs[n], earlier).alias(inputs[n]) for n, v in values.items()],
    )
    within = Window.partitionBy(*keys, SLICE).orderBy(_ROW, *order)
    return (
        dealt(rows.unionByName(carry, allowMissingColumns=True))
        .withColumns({n: v.over(inputs[n], within) for n, v in values.items()})
        .filter(F.col(_ROW) == 1)
        .drop(_ROW, *([] if keep_slices else [SLICE]), *inputs.values())
    )


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "row_no") -> DataFrame:
    """1-based row number per key over a sliced frame."""
    return running(df, keys, order, {out: Running("sum", F.lit(1))})


def number_all(df: DataFrame, order: Sequence[Column | str], out: str = "row_no") -> DataFrame:
    """1-based row number over the whole frame without a single-task sort.

    Rows are range-partitioned on ``order``, numbered inside their partition and
    shifted by the sizes of the partitions before (one row per partition).
    """
    sorted_parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut_lineage(sorted_parts.withColumn(_ROW, F.monotonically_increasing_id()))
    part = F.shiftright(F.col(_ROW), 33)
    local = F.col(_ROW).bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(part.alias(SLICE))
        .count()
        .select(SLICE, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    )
    return (
        # One row per partition of this frame, so the broadcast is bounded.
        placed.withColumn(SLICE, part)
        .join(F.broadcast(offsets), SLICE)
        .withColumn(out, F.col("__before") + local + 1)
        .drop(SLICE, _ROW, "__before")
    )


def trailing(df: DataFrame, keys: Sequence[str], number: str, width: int, values: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """Aggregate over ``(n - width, n]`` at each row; rows are unique per (keys, number).

    ``values`` maps a name to (sum, min or max, Column). Time is cut into blocks
    of ``width``: a frame is the head of the row's own block and the tail of the
    block before, and each is a running value inside one block. For it a row goes
    to its own block and, moved on by ``width``, to the next, and nowhere after.
    Cost grows with the rows and not with the rows per frame, and a key is spread
    over its blocks.
    """
    if width < 1:
        raise ValueError("window width must be at least 1")
    inputs = {name: f"__in_{i}" for i, name in enumerate(values)}
    at = F.col(number)

    def placed(position: Column, is_row: bool) -> DataFrame:
        return df.select(
            *keys,
            number,
            position.alias("__at"),
            F.floor(position / F.lit(width)).alias(SLICE),
            F.lit(is_row).alias(_ROW),
            *[v.alias(inputs[n]) for n, (_, v) in values.items()],
        )

    both = placed(at, True).unionByName(placed(at + F.lit(width), False))
    block = Window.partitionBy(*keys, SLICE)
    head = block.orderBy("__at", F.col(_ROW).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # What the block before holds after ``at - width``, which excludes a row moved on to ``at`` itself.
    tail = block.orderBy(F.col("__at").desc(), F.col(_ROW).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = both.select(
        *keys,
        number,
        _ROW,
        *[_FOLDS[kind](F.when(F.col(_ROW), F.col(inputs[n]))).over(head).alias(f"{inputs[n]}_head") for n, (kind, _) in values.items()],
        *[_FOLDS[kind](F.when(~F.col(_ROW), F.col(inputs[n]))).over(tail).alias(f"{inputs[n]}_tail") for n, (kind, _) in values.items()],
    )
    return parts.filter(_ROW).select(
        *keys, number, *[_BOTH[kind](F.col(f"{inputs[n]}_head"), F.col(f"{inputs[n]}_tail")).alias(n) for n, (kind, _) in values.items()]
    )
