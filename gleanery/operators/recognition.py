"""Recognised words and table cells, assembled into documents and tables.

Input is the recogniser's output, one row per word ``(doc_id, word_idx, text,
conf 0..100, left, top, width, height)`` or per cell. Confidence leaves on one
scale, 0..1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions.text import is_blank, noise_count, word_count

MIN_CELLS = 4
TABLE_CONFIDENCE = 0.90
# Boxes in one row of text. Every document is laid out so, and judged as a whole.
PART_WORDS = 50_000
#: Words laid out together; a part that has more is laid out alone.
HELD_WORDS = 200_000
BOX = ("left", "top", "width", "height")
WORD = ("word_idx", "text", "conf", *BOX)


def assemble_text(words: DataFrame, doc: str = "doc_id", part_words: int = PART_WORDS) -> DataFrame:
    """Text in word order, boxes, and what the whole document is judged by.

    A document is rows ``part`` 0, 1, .. of ``part_words`` boxes each. On every one of
    them ``confidence`` (boxes with -1 left out), ``word_count``, ``noise`` (share of
    noise characters in the joined text) and ``blank`` are the whole document's, so a
    decision cannot differ between parts. Words without an index come first, and words
    without a document make up a document of their own.
    """
    conf = F.when(F.col("conf") != -1, F.col("conf"))
    place = F.coalesce(F.floor(F.col("word_idx") / F.lit(part_words)), F.lit(0).cast("long"))
    keyed = words.select(F.col(doc), place.alias("part"), *WORD)
    written = F.coalesce(F.col("text"), F.lit(""))
    counts = keyed.groupBy(doc, "part").agg(
        F.sum(conf).alias("sum"),
        F.count(conf).alias("sure"),
        F.sum(word_count(F.col("text"))).alias("words"),
        F.sum(noise_count(written)).alias("noise"),
        F.sum(F.length(written)).alias("chars"),
        F.count("*").alias("boxes"),
        F.bool_and(is_blank(F.col("text"))).alias("blank"),
    )
    whole = Window.partitionBy(doc)
    total = lambda c: F.sum(c).over(whole)
    totals = counts.select(
        doc,
        "part",
        (F.coalesce(total("sum") / total("sure"), F.lit(0.0)) / 100).alias("confidence"),
        total("words").alias("word_count"),
        F.try_divide(total("noise"), total("chars") + total("boxes") - 1).alias("noise"),
        F.bool_and("blank").over(whole).alias("blank"),
    )
    # The totals go to their parts as rows of the same grouping: no text meets a join.
    judged = ("confidence", "word_count", "noise", "blank")
    grouped = _runs(keyed).unionByName(totals, allowMissingColumns=True).groupBy(doc, "part")
    packed = grouped.agg(F.collect_list("run").alias("runs"), *[F.max(c).alias(c) for c in judged])
    return _laid_out(packed, keyed)


def _runs(keyed: DataFrame) -> DataFrame:
    """Neighbouring words of one part as one row, ``run``: a compressed Arrow batch.

    A recogniser gives a document's words one after another, so few rows are left to
    shuffle. Where they come mixed there are more and shorter runs of the same words.
    """

    def differs(column: pa.Array) -> np.ndarray | bool:
        if pa.types.is_nested(column.type):
            return True
        one, two = column[:-1], column[1:]
        same = pc.or_(pc.fill_null(pc.equal(one, two), False), pc.and_(pc.is_null(one), pc.is_null(two)))
        return ~same.to_numpy(zero_copy_only=False)

    def packed(words: pa.RecordBatch) -> bytes:
        plain = words.serialize()
        return plain.size.to_bytes(8, "little") + pa.compress(plain, "zstd", asbytes=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = np.ones(batch.num_rows, dtype=bool)
            first[1:] = differs(batch.column(0)) | differs(batch.column(1))
            starts = np.flatnonzero(first)
            words = batch.select(WORD).cast(schema)
            runs = [packed(words.slice(a, b - a)) for a, b in zip(starts, [*starts[1:], batch.num_rows])]
            keys = [c.take(pa.array(starts)) for c in batch.columns[:2]]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(runs, pa.binary())], names=[*batch.schema.names[:2], "run"])

    schema = _word_schema(keyed)
    return keyed.mapInArrow(run, T.StructType([*keyed.schema.fields[:2], T.StructField("run", T.BinaryType())]))


def _word_schema(keyed: DataFrame) -> pa.Schema:
    return keyed.select(*WORD).limit(0).toArrow().schema


def _laid_out(packed: DataFrame, keyed: DataFrame) -> DataFrame:
    """The runs of every part as its text, words and boxes, some :data:`HELD_WORDS` at a time.

    Words of one index stay as they came.
    """

    def unpacked(run: bytes) -> pa.RecordBatch:
        plain = pa.decompress(memoryview(run)[8:], int.from_bytes(run[:8], "little"), "zstd")
        return pa.ipc.read_record_batch(plain, schema)

    def laid_out(rows: pa.RecordBatch, pieces: list[list[pa.RecordBatch]]) -> pa.RecordBatch:
        sizes = np.array([sum(p.num_rows for p in own) for own in pieces])
        words = pa.Table.from_batches([p for own in pieces for p in own], schema)
        words = words.append_column("row", pa.array(np.repeat(np.arange(len(sizes)), sizes)))
        words = words.append_column("at", pa.array(np.arange(words.num_rows)))
        words = words.take(pc.sort_indices(words, [(c, "ascending") for c in ("row", "word_idx", "at")], null_placement="at_start")).combine_chunks()
        column = {n: words[n].combine_chunks() for n in WORD}
        ends = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
        text = pc.binary_join(pa.ListArray.from_arrays(ends, pc.fill_null(column["text"], "")), " ")
        pairs = pa.StructArray.from_arrays([column["text"], column["conf"]], ["text", "conf"])
        n = words.num_rows
        sides = pa.concat_arrays([column[c].cast(side) for c in BOX])
        box = sides.take(pa.array((np.arange(n)[:, None] + n * np.arange(len(BOX))).ravel()))
        boxes = pa.ListArray.from_arrays(pa.array(np.arange(0, len(BOX) * n + 1, len(BOX)), pa.int32()), box)
        lists = [pa.ListArray.from_arrays(ends, c) for c in (pairs, boxes)]
        return pa.RecordBatch.from_arrays([*rows.columns[:2], text, *lists, *rows.columns[3:]], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, held, pieces = 0, 0, []
            for k, runs in enumerate(batch.column(2), 1):
                pieces.append([unpacked(r.as_py()) for r in runs.values])
                held += sum(p.num_rows for p in pieces[-1])
                if held >= HELD_WORDS or k == batch.num_rows:
                    yield laid_out(batch.slice(start, k - start), pieces)
                    start, held, pieces = k, 0, []

    schema = _word_schema(keyed)
    shape = keyed.select(F.array(F.struct("text", "conf")).alias("words"), F.array(F.array(*BOX)).alias("boxes"))
    side = keyed.select(F.array(*BOX)[0].alias("side")).limit(0).toArrow().schema.field("side").type
    out = T.StructType([*packed.schema.fields[:2], T.StructField("text", T.StringType()), *shape.schema.fields, *packed.schema.fields[3:]])
    names = out.names
    return packed.mapInArrow(run, out)


def text_confidence(words: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Only the confidence and counts: plain partial aggregates, no text gathered."""
    conf = F.when(F.col("conf") != -1, F.col("conf"))
    return words.groupBy(doc).agg(
        (F.coalesce(F.avg(conf), F.lit(0.0)) / 100).alias("confidence"),
        F.coalesce(F.sum(word_count(F.col("text"))), F.lit(0)).alias("word_count"),
        F.count("*").alias("boxes"),
    )


def assemble_table(cells: DataFrame, by: tuple[str, ...] = ("doc_id", "table_idx")) -> DataFrame:
    """Rows = distinct y, columns = distinct x, mean confidence; valid with enough sure cells.

    ``coordinates`` is ``[x, y, width, height]``, ``confidence`` 0..1. Rows and columns
    are grouped each by themselves, so that no cell is multiplied for distinct counts.
    """
    x, y = F.col("coordinates")[0], F.col("coordinates")[1]
    # Decimal sums do not depend on the order of addition.
    rows = cells.groupBy(*by, y.alias("y")).agg(F.count("*").alias("n"), F.sum(F.col("confidence").cast("decimal(20,9)")).alias("s"))
    columns = cells.select(*by, x.alias("x")).distinct()
    confidence = (F.sum("s") / F.sum("n")).cast("double")
    return rows.unionByName(columns, allowMissingColumns=True).groupBy(*by).agg(
        F.count("y").alias("rows"),
        F.count("x").alias("columns"),
        F.sum("n").alias("cells"),
        confidence.alias("confidence"),
        ((F.sum("n") >= MIN_CELLS) & (F.sum("s") >= F.sum("n") * F.lit(TABLE_CONFIDENCE).cast("decimal(20,9)"))).alias("valid"),
    )


def format_ocr(df: DataFrame, fmt: str, doc: str = "doc_id") -> DataFrame:
    """``txt``: the text alone; ``json``: text, words, boxes and confidence as JSON."""
    fmt = fmt.lower()
    if fmt == "txt":
        body = F.col("text")
    elif fmt == "json":
        body = F.to_json(F.struct("text", "words", "boxes", "confidence"))
    else:
        raise ValueError("output format must be txt or json")
    return df.select(doc, *[c for c in ("part",) if c in df.columns], body.alias("body"))
