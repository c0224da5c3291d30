"""Quality rules with adaptive thresholds.

Each text is counted once. A mergeable quantile sketch per language, source and measure
(counts of values in bins of bounded relative width) then says what is usual there, and
a document that passes the fixed base rules is kept when none of its measures lies far
outside. The fences of a source are pulled towards those of its language and these towards
those of all documents, the more so the fewer documents there are: the wider sketches are
the sums of the smaller ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm.common import required, short_batches
from gleanery.session import stored

# Fixed values of the base rules.
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
WINDOW = 5
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"

#: Bits of a value that its bin keeps: bins are at most 1/32 wide, relative to their value.
BIN_BITS = 6


@dataclass(frozen=True)
class Measure:
    """A whole number per document, and how far beyond its quartile it may lie.

    The fence is the upper quartile, plus ``REACH`` times its distance from the median,
    plus ``slack``; or the ``TAIL``-th percentile plus half the slack, whichever is less,
    so that a clean source is held to its own tail even where its quartiles are zero.
    With ``both`` there is a fence below the quartiles as well, at 0 at least.
    """

    name: str
    value: str
    slack: int
    both: bool = False


REACH = 3
TAIL = 99
MEASURES = (
    Measure("symbols", "n_symbols * 10000 div greatest(word_chars, 1)", 500),
    Measure("dup_lines", "n_dup_lines * 10000 div greatest(n_lines, 1)", 5000),
    Measure("repeats", "n_repeat_words * 10000 div greatest(n_words, 1)", 1700),
    Measure("capitals", "n_capitals * 10000 div greatest(word_chars, 1)", 2000),
    Measure("length", "word_chars * 100 div greatest(n_words, 1)", 150, both=True),
)
#: The next wider sketch's fence counts as much as that of so many documents.
WIDER_ROWS = 100

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")
_CONTINUATION = bytes(range(0x80, 0xC0))
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside a window of ``width`` words that the text has twice or more."""
    if len(words) <= width:
        return 0
    numbers: dict[bytes, int] = {}
    at = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    # Windows are numbered exactly: the number of the first words, then one word more.
    window, distinct = at[: len(at) - width + 1], len(numbers)
    for k in range(1, width):
        if distinct * len(numbers) >= 1 << 62:
            kinds, window = np.unique(window, return_inverse=True)
            distinct = len(kinds)
        window = window * len(numbers) + at[k : len(at) - width + 1 + k]
        distinct *= len(numbers)
    _, place, times = np.unique(window, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(times[place] > 1)
    if not len(starts):
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    edges[starts] += 1
    edges[starts + width] -= 1
    return int((np.cumsum(edges) > 0).sum())


def counts_of(text: bytes) -> tuple[int, ...]:
    """The counts of one text, in the order of ``_COUNTS``."""
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text.translate(None, _CONTINUATION + SPACES)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(text) - len(text.translate(None, _CAPITALS)),
    )


def count_text(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """The ``keys`` and counts of every row; null counts as a text without words."""
    short_batches(docs.sparkSession)
    schema = T.StructType([*[docs.schema[k] for k in keys], *[T.StructField(c, T.LongType()) for c in _COUNTS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keys)).cast(pa.binary()).to_pylist()
            counts = np.array([counts_of(t or b"") for t in texts], np.int64).reshape(len(texts), len(_COUNTS))
            columns = [*batch.columns[: len(keys)], *[pa.array(c) for c in counts.T.copy()]]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(*keys, text_col).mapInArrow(run, schema)


def _width(value: Column) -> Column:
    """Lowest bits of a value that its bin does not keep."""
    return F.greatest(F.length(F.bin(value)) - F.lit(BIN_BITS), F.lit(0))


def sketch(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mergeable quantile sketch of each measure per key: rows per bin (low .. high).

    Two sketches merge by adding the counts of equal bins, so partial ones are made
    before the shuffle and no key gathers its rows.
    """
    values = F.array(*[F.struct(F.lit(m.name).alias("measure"), F.expr(m.value).alias("value")) for m in MEASURES])
    long = rows.select(*keys, F.explode(values).alias("m")).select(*keys, "m.measure", "m.value")
    long = long.withColumn("width", _width(F.col("value"))).selectExpr(
        *keys, "measure", "shiftleft(shiftright(value, width), width) AS low", "shiftleft(1L, width) - 1 AS gap"
    )
    return long.groupBy(*keys, "measure", "low", (F.col("low") + F.col("gap")).alias("high")).agg(F.count("*").alias("n"))


def fences(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the number of rows and, per measure, the values it may not pass."""
    order = Window.partitionBy(*keys, "measure").orderBy("low")
    placed = sketches.withColumn("reached", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "total", F.sum("n").over(Window.partitionBy(*keys, "measure"))
    )

    def at(percent: int, edge: str) -> Column:
        return F.min(F.when(F.col("reached") * 100 >= F.col("total") * percent, F.col(edge)))

    points = placed.groupBy(*keys, "measure").agg(
        F.max("total").alias("total"),
        at(25, "low").alias("q1"),
        at(50, "low").alias("mid_low"),
        at(50, "high").alias("mid_high"),
        at(75, "high").alias("q3"),
        at(TAIL, "high").alias("tail"),
    )
    made = [F.max("total").alias("rows")]
    for m in MEASURES:
        up = F.least(F.col("q3") + REACH * (F.col("q3") - F.col("mid_high")) + m.slack, F.col("tail") + m.slack // 2)
        down = F.greatest(F.col("q1") - REACH * (F.col("mid_low") - F.col("q1")) - m.slack, F.lit(0))
        made.append(F.max(F.when(F.col("measure") == m.name, up)).alias(f"most_{m.name}"))
        if m.both:
            made.append(F.max(F.when(F.col("measure") == m.name, down)).alias(f"least_{m.name}"))
    return points.groupBy(*keys).agg(*made)


def _edges() -> list[str]:
    return [n for m in MEASURES for n in ([f"most_{m.name}", f"least_{m.name}"] if m.both else [f"most_{m.name}"])]


def _pulled(level: str, edge: str, wider: str) -> str:
    """A level's fence as it stands among the next wider one's, weighed by rows; no size makes it jump."""
    return f"(({level}.rows * {level}.{edge} + {WIDER_ROWS} * {wider}) div ({level}.rows + {WIDER_ROWS}))"


def thresholds(passing: DataFrame) -> DataFrame:
    """Fences per (lang, source), each pulled towards its language's and that towards all rows'."""
    own = stored(sketch(passing, ["lang", "source"]), "sketches")
    wider = own.groupBy("lang", "measure", "low", "high").agg(F.sum("n").alias("n"))
    widest = wider.groupBy("measure", "low", "high").agg(F.sum("n").alias("n"))
    group = fences(own, ["lang", "source"])
    language = fences(wider, ["lang"]).select(F.col("lang").alias("l"), F.struct("rows", *_edges()).alias("w"))
    every = fences(widest.withColumn("one", F.lit(1)), ["one"]).select(F.struct("rows", *_edges()).alias("a"), "one")
    joined = (
        group.select("lang", "source", F.lit(1).alias("one"), F.struct("rows", *_edges()).alias("o"))
        .join(language, F.col("lang").eqNullSafe(F.col("l")))
        .join(every, "one")
    )
    return joined.select("lang", "source", *[F.expr(_pulled("o", e, _pulled("w", e, f"a.{e}"))).alias(e) for e in _edges()])


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: counts, ``base_failed`` and ``kept``.

    Rows without a language or source form groups of their own. A text that is null or
    has no words fails the base rules. Repeated rows each count. An empty table gives
    no rows. Columns other than id, text, ``lang`` and ``source`` are ignored.
    """
    required(docs, id_col, text_col, "lang", "source")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    counted = stored(
        count_text(docs, [id_col, "lang", "source"], text_col).withColumn("base_failed", failed), "text_counts"
    )
    # One row per language and source, with a measured size.
    limits = stored(thresholds(counted.filter(~F.col("base_failed"))), "thresholds")
    limits = limits.withColumnsRenamed({"lang": "l", "source": "s"})
    same = F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s"))
    inside = ~F.col("base_failed")
    for m in MEASURES:
        inside = inside & (F.expr(m.value) <= F.col(f"most_{m.name}"))
        if m.both:
            inside = inside & (F.expr(m.value) >= F.col(f"least_{m.name}"))
    return counted.join(limits, same, "left").select(
        id_col, *_COUNTS[:5], "base_failed", F.coalesce(inside, F.lit(False)).alias("kept"), *_COUNTS[5:]
    )


def _oracle() -> str:
    """The same in SQL."""
    values = {m.name: m.value.replace(" div ", " // ") for m in MEASURES}
    measured = " UNION ALL ".join(f"SELECT lang, source, '{n}' AS measure, {v} AS value FROM passing" for n, v in values.items())
    levels = (("lang, source", "own"), ("lang", "wider"), ("1", "widest"))
    parts = []
    for keys, name in levels:
        named = "1 AS one" if keys == "1" else keys
        by = "one" if keys == "1" else keys
        parts.append(f"""
    {name}_placed AS (
      SELECT *, sum(n) OVER (PARTITION BY {by}, measure ORDER BY low) AS reached, sum(n) OVER (PARTITION BY {by}, measure) AS total
      FROM (SELECT {named}, measure, low, high, count(*) AS n FROM binned GROUP BY ALL)),
    {name}_points AS (
      SELECT {by}, measure, max(total) AS total, min(low) FILTER (reached * 100 >= total * 25) AS q1,
             min(low) FILTER (reached * 100 >= total * 50) AS mid_low, min(high) FILTER (reached * 100 >= total * 50) AS mid_high,
             min(high) FILTER (reached * 100 >= total * 75) AS q3, min(high) FILTER (reached * 100 >= total * {TAIL}) AS tail
      FROM {name}_placed GROUP BY ALL),
    {name} AS (
      SELECT {by}, max(total) AS rows, {", ".join(
          f"max(least(q3 + {REACH} * (q3 - mid_high) + {m.slack}, tail + {m.slack // 2})) FILTER (measure = '{m.name}') AS most_{m.name}"
          + (f", max(greatest(q1 - {REACH} * (mid_low - q1) - {m.slack}, 0)) FILTER (measure = '{m.name}') AS least_{m.name}" if m.both else "")
          for m in MEASURES)}
      FROM {name}_points GROUP BY ALL)""")
    pick = lambda e: _pulled("o", e, _pulled("w", e, f"a.{e}")).replace(" div ", " // ")
    inside = " AND ".join(
        f"({values[m.name]}) <= {pick(f'most_{m.name}')}" + (f" AND ({values[m.name]}) >= {pick(f'least_{m.name}')}" if m.both else "")
        for m in MEASURES
    )
    return rf"""
    WITH texts AS (
      SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
      FROM documents),
    spots AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM texts),
    grams AS (
      SELECT r, i, [word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o] AS g,
             lead(word, 4) OVER o IS NOT NULL AS full_window
      FROM spots WINDOW o AS (PARTITION BY r ORDER BY i)),
    twice AS (SELECT r, i, full_window AND count(*) OVER (PARTITION BY r, g, full_window) > 1 AS again FROM grams),
    covered AS (
      SELECT r, bool_or(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c FROM twice),
    repeated AS (SELECT r, count(*) FILTER (c) AS n FROM covered GROUP BY r),
    counted AS (
      SELECT t.r, doc_id, lang, source, len(w)::BIGINT AS n_words,
             length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
             len(lines)::BIGINT AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals
      FROM texts t LEFT JOIN repeated USING (r)),
    marked AS (
      SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words AS base_failed FROM counted),
    passing AS (SELECT * FROM marked WHERE NOT base_failed),
    measured AS ({measured}),
    wide AS (SELECT *, greatest(length(bin(value)) - {BIN_BITS}, 0)::INT AS width FROM measured),
    binned AS (SELECT lang, source, measure, (value >> width) << width AS low, ((value >> width) << width) + (1::BIGINT << width) - 1 AS high FROM wide),
    {",".join(parts)}
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           coalesce(NOT base_failed AND {inside}, false) AS kept, n_lines, n_capitals
    FROM marked m LEFT JOIN own o ON o.lang IS NOT DISTINCT FROM m.lang AND o.source IS NOT DISTINCT FROM m.source
    LEFT JOIN wider w ON w.lang IS NOT DISTINCT FROM m.lang LEFT JOIN widest a ON a.one = 1
    """


ORACLE_SQL = _oracle()
