"""Sharding as a minimax contiguous partition.

Groups of equal texts are atomic and ordered by their smallest id. The smallest shard
capacity for which a greedy fill needs no more than the wanted shards is found by search
over capacities, and the order is cut where that fill cuts.

Rows are range-partitioned in that order, so running sums need one number per partition.
A greedy step is "the last group start at or below this sum": the partition that holds
it is known from those numbers, and only its rows are read. Each pass tries many
capacities at once, so few passes are needed whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import last, required, whole
from gleanery.session import stored

#: Capacities tried in one pass.
TRIED = 256


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of an ordered partition and sum the sizes before each."""
    part, rows, total = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        size = batch.column("size").to_numpy()
        before = total + np.cumsum(size) - size
        place = rows + np.arange(len(size))
        made = [pa.array(np.full(len(size), part, np.int64)), pa.array(place), pa.array(before)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "part", "place", "before"])
        rows, total = rows + len(size), total + int(size.sum())


class _Starts:
    """Sums at which a group starts, looked up without reading more than is needed."""

    def __init__(self, starts: DataFrame, parts: list[tuple[int, int, int]], total: int) -> None:
        # Of each partition that has a group start: number, sum before it, first start.
        self._starts, self._total = starts, total
        self._numbers = np.array([p for p, _, _ in parts], np.int64)
        self._offsets = np.array([o for _, o, _ in parts], np.int64)
        self._firsts = np.array([f for _, _, f in parts], np.int64)

    def at_most(self, wanted: np.ndarray) -> np.ndarray:
        """For each number, the largest group start at or below it; the total if it is reached."""
        found = np.where(wanted >= self._total, self._total, -1)
        open_ = np.unique(wanted[found < 0])
        if not len(open_):
            return found
        home = np.searchsorted(self._firsts, open_, "right") - 1
        asked = {int(self._numbers[h]): open_[home == h] - self._offsets[h] for h in np.unique(home)}

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[tuple[int, int], int] = {}
            for batch in batches:
                part, before = batch.column("part").to_numpy(), batch.column("before").to_numpy()
                for p in np.unique(part):
                    own = before[part == p]
                    at = np.searchsorted(own, asked[int(p)], "right") - 1
                    for i in np.flatnonzero(at >= 0):
                        key = (int(p), int(i))
                        best[key] = max(best.get(key, -1), int(own[at[i]]))
            if best:
                keys = list(best)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]), pa.array(list(best.values()))],
                    names=["part", "i", "before"],
                )

        needed = self._starts.filter(F.col("part").isin(list(asked))).select("part", "before")
        rows = needed.mapInArrow(look, "part long, i long, before long").groupBy("part", "i").agg(F.max("before").alias("b"))
        offset = dict(zip(self._numbers.tolist(), self._offsets.tolist()))
        # As many rows as numbers were asked for.
        answer = {int(asked[r.part][r.i]) + offset[r.part]: r.b + offset[r.part] for r in rows.collect()}
        return np.array([f if f >= 0 else answer[int(w)] for f, w in zip(found, wanted)], np.int64)


def _cuts(starts: _Starts, total: int, largest: int, shards: int) -> list[int]:
    """Where the greedy fill with the smallest feasible capacity cuts."""

    def fill(capacities: np.ndarray) -> list[np.ndarray]:
        reached, ends = np.zeros(len(capacities), np.int64), []
        for _ in range(shards):
            reached = starts.at_most(reached + capacities)
            ends.append(reached)
        return ends

    low = max(-(-total // shards), largest)
    high = -(-total // shards) + largest
    while low < high:
        tried = np.unique(np.linspace(low, high - 1, min(TRIED, high - low)).astype(np.int64))
        done = np.flatnonzero(fill(tried)[-1] >= total)
        if len(done):
            high = int(tried[done[0]])
            low = int(tried[done[0] - 1]) + 1 if done[0] else low
        else:
            low = int(tried[-1]) + 1
    return [int(e[0]) for e in fill(np.array([low], np.int64))[:-1]]


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) per row of ``docs``.

    The law is ``bytes``: the largest shard is as small as whole groups of equal texts,
    kept in order, allow. A size is the UTF-8 bytes plus one; a null text has none and
    is grouped with the empty texts. ``slot`` numbers a shard's rows from 0 in order of
    (smallest id of the group, id); null ids come last, and rows with the same id and
    text follow each other. A shard may be empty when there are fewer groups than
    shards. An empty table gives no rows; other columns are ignored.
    """
    if shards < 1:
        raise ValueError("need at least one shard")
    required(docs, id_col, text_col)
    text = whole(text_col)
    rows = stored(
        docs.select(
            F.struct(last(F.col(id_col)).alias("id"), F.monotonically_increasing_id().alias("row")).alias("own"),
            (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.sha2(text, 256).alias("digest"),
        ),
        "sizes",
    )
    groups = stored(
        rows.groupBy("digest").agg(F.min("own").alias("first"), F.sum("size").alias("bytes"), F.count("*").alias("n")).filter("n > 1"),
        "text_groups",
    )
    grouped = rows.join(groups.select("digest", "first"), "digest", "left").withColumn("first", F.coalesce("first", "own"))
    ordered = grouped.select("first", "own", "size", "text_crc32").repartitionByRange("first", "own").sortWithinPartitions("first", "own")
    flat = ordered.select(
        F.col("own.id.value").alias("doc_id"), "size", "text_crc32", (F.col("first") == F.col("own")).alias("starts")
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in flat.schema.fields)
    placed = stored(flat.mapInArrow(_running, f"{schema}, part long, place long, before long"), "ordered_sizes")

    # One row per partition.
    parts = (
        placed.groupBy("part")
        .agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min(F.when(F.col("starts"), F.col("before"))).alias("first"))
        .orderBy("part")
        .collect()
    )
    offsets, bytes_before, rows_before = [], 0, 0
    for p in parts:
        offsets.append((p["part"], bytes_before, rows_before, p["first"]))
        bytes_before, rows_before = bytes_before + p["bytes"], rows_before + p["n"]
    total = bytes_before
    sizes = [rows.agg(F.max("size").alias("m")).first()["m"], groups.agg(F.max("bytes").alias("m")).first()["m"]]
    cuts: list[int] = []
    if total:
        having = [(p, o, o + first) for p, o, _, first in offsets if first is not None]
        starts = _Starts(placed.filter("starts"), having, total)
        cuts = _cuts(starts, total, max(s for s in sizes if s is not None), shards)

    spark = docs.sparkSession
    # One row per partition, as above.
    shift = F.broadcast(
        spark.createDataFrame([(p, o, r) for p, o, r, _ in offsets], "part long, bytes_before long, rows_before long")
    )
    number = sum((F.when(F.col("at") >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    dealt = (
        placed.join(shift, "part")
        .withColumn("at", F.col("before") + F.col("bytes_before"))
        .withColumn("row", F.col("place") + F.col("rows_before"))
        .withColumn("shard", number.cast("int"))
    )
    firsts = {r["shard"]: r["row"] for r in dealt.groupBy("shard").agg(F.min("row").alias("row")).collect()}
    first = sum((F.when(F.col("shard") == s, F.lit(r)).otherwise(F.lit(0)) for s, r in firsts.items()), F.lit(0))
    return dealt.select(
        F.col("doc_id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row") - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
