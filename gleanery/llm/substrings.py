"""Repeated byte strings across a corpus, by a sparse suffix array.

Sorting every suffix of a corpus would move it a hundred times over. Instead each window
of ``LENGTH`` bytes names one suffix: the one of its ``LEAD``-byte leads with the smallest
hash. Equal windows name the same suffix at the same place, so sorting the named suffixes
(one in about 35) by their leads brings all equal windows together.

Sampled splitters range-partition the suffixes by lead, context and position, so one very
common passage spreads over tasks. A task walks its sorted bucket: a suffix whose whole
context stands before it in the bucket covers repeated bytes; suffixes with a common lead
but different contexts, and those at the two ends of a bucket, are compared window by
window over all buckets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm.common import filtered_scans, last, required, short_batches, whole
from gleanery.session import stored

#: Length of the strings looked for, in bytes, and of the lead that names a suffix.
LENGTH = 100
LEAD = 32
#: Contexts of one lead, of at most 168 bytes each, that are compared in one place. Those
#: of a lead with more meet by the hashes of their windows.
FEW = 4096
#: Windows handled at once in a long text.
BLOCK = 1 << 20

_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hash:
    """Hashes of any substring of a block, from running sums of powers."""

    def __init__(self, base: int) -> None:
        size = BLOCK + 2 * LENGTH + 1
        inverse = pow(base, -1, 1 << 64)
        self._table = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(base))
        self._powers = self._series(base, size)
        self._inverse = self._series(inverse, size)

    @staticmethod
    def _series(base: int, size: int) -> np.ndarray:
        out = np.full(size, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    def load(self, data: np.ndarray) -> np.ndarray:
        """Running sums; entry i covers the bytes before i."""
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self._table[data] * self._powers[: len(data)], dtype=np.uint64, out=sums[1:])
        return sums

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((sums[end] - sums[start]) * self._inverse[start] + (end - start).astype(np.uint64))


_HASHES: list[_Hash] = []


def _hashes() -> list[_Hash]:
    """Built once per worker."""
    if not _HASHES:
        _HASHES.extend(_Hash(b) for b in _BASES)
    return _HASHES


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, from minima towards both ends of blocks."""
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    count = len(x) - width + 1
    return np.minimum(back[:count], ahead[width - 1 : width - 1 + count])


def named_suffixes(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(lead, context, first window, number of windows) of the suffixes of one text."""
    own = _hashes()[0]
    windows = len(data) - LENGTH + 1
    for begin in range(0, max(windows, 0), BLOCK):
        count = min(BLOCK, windows - begin)
        part = data[begin : begin + count + LENGTH - 1]
        sums = own.load(part)
        at = np.arange(len(part) - LEAD + 1)
        lead = own.of(sums, at, at + LEAD)
        # The hash leads and the place breaks ties, so equal windows choose alike.
        order = (lead & np.uint64(0xFFFFFFFFFF000000)) | at.astype(np.uint64)
        chosen = _sliding_min(order, LENGTH - LEAD + 1)
        place = (chosen & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        number = np.diff(first, append=count)
        context = own.of(sums, first, first + number + LENGTH - 1)
        yield lead[place[first]], context, first + begin, number


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _suffixes(texts: DataFrame) -> DataFrame:
    """(lead, context, doc, place): a named suffix; ``place`` packs its first window and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lead", "context", "doc", "place"]
        for batch in batches:
            found = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                for lead, context, first, number in named_suffixes(np.frombuffer(text, np.uint8)):
                    found.append((lead, context, np.full(len(lead), doc, np.int64), (first << 8) | number))
                    if sum(len(f[0]) for f in found) > BLOCK:
                        yield pa.RecordBatch.from_arrays([_longs(np.concatenate(c)) for c in zip(*found)], names=names)
                        found = []
            if found:
                yield pa.RecordBatch.from_arrays([_longs(np.concatenate(c)) for c in zip(*found)], names=names)

    return texts.mapInArrow(run, "lead long, context long, doc long, place long")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats in one sorted bucket: (lead, doc, place, repeated).

    ``repeated``: the same lead and context stand before. Otherwise the suffix is the
    first of its context here, and its lead has other contexts or lies at an end of the
    bucket, so its windows have yet to be compared.
    """

    def rows(lead: np.ndarray, doc: np.ndarray, place: np.ndarray, repeated: bool) -> pa.RecordBatch:
        columns = [pa.array(lead), pa.array(doc), pa.array(place), pa.array(np.full(len(doc), repeated))]
        return pa.RecordBatch.from_arrays(columns, names=["lead", "doc", "place", "repeated"])

    lead_before = context_before = None
    last_row: tuple[int, int] | None = None
    # Of the current lead: contexts seen, and the first of them while it is the only one.
    contexts, held, first_lead = 0, None, True
    for batch in batches:
        lead, context, doc, place = (c.to_numpy() for c in batch.columns)
        if not len(lead):
            continue
        new_lead = np.ones(len(lead), bool)
        new_lead[1:] = lead[1:] != lead[:-1]
        new_lead[0] = lead[0] != lead_before
        new_context = new_lead.copy()
        new_context[1:] |= context[1:] != context[:-1]
        new_context[0] |= context[0] != context_before
        # A row given twice is one row.
        same = np.zeros(len(lead), bool)
        same[1:] = ~new_context[1:] & (doc[1:] == doc[:-1]) & (place[1:] == place[:-1])
        same[0] = not new_context[0] and last_row == (int(doc[0]), int(place[0]))
        run = np.cumsum(new_lead)
        total = np.bincount(run, weights=new_context, minlength=run[-1] + 1).astype(np.int64)
        total[0] += contexts
        # The bucket's first lead may go on from the bucket before.
        many = total > 1
        if first_lead:
            many[run[0]] = True
        if held is not None and (many[0] or run[-1] > 0):
            if many[0]:
                yield rows(*held, False)
            held = None
        repeated = ~new_context & ~same
        if repeated.any():
            yield rows(lead[repeated], doc[repeated], place[repeated], True)
        compare = new_context & many[run]
        if compare.any():
            yield rows(lead[compare], doc[compare], place[compare], False)
        end = run[-1]
        if not many[end] and new_context[run == end].any():
            at = np.flatnonzero((run == end) & new_context)
            held = (lead[at], doc[at], place[at])
        if end > 0 and (end > 1 or not new_lead[0] or lead_before is not None):
            first_lead = False
        contexts = int(total[end])
        lead_before, context_before, last_row = lead[-1], context[-1], (int(doc[-1]), int(place[-1]))
    if held is not None:
        # The next bucket may begin with this lead.
        yield rows(*held, False)


def _contexts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(lead, n, doc, start, context) of the wanted suffixes: the bytes their windows cover."""
    places = wanted.groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("place", "lead", "n"))).alias("places"))
    # The condition that the list is not empty tells Spark that the texts are few.
    places = stored(places, "wanted_suffixes").filter(F.size("places") > 0)
    joined = texts.join(places, "doc").select("doc", "text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, found in zip(*(c.to_pylist() for c in batch.columns)):
                data = text.encode()
                first = [p["place"] >> 8 for p in found]
                cut = [data[f : f + (p["place"] & 0xFF) + LENGTH - 1] for f, p in zip(first, found)]
                columns = [[p["lead"] for p in found], [p["n"] for p in found], [doc] * len(found), first]
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(c, pa.int64()) for c in columns], pa.array(cut, pa.binary())],
                    names=["lead", "n", "doc", "start", "context"],
                )

    return joined.mapInArrow(run, "lead long, n long, doc long, start long, context binary")


def _compare_few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, start, end) of the repeated windows of leads with few contexts, sorted by lead."""
    lead_before, row_before, seen = None, None, set()
    for batch in batches:
        out = []
        for lead, doc, start, context in zip(*(c.to_pylist() for c in batch.columns)):
            if lead != lead_before:
                lead_before, seen = lead, set()
            elif (doc, start) == row_before:
                continue
            row_before, since = (doc, start), None
            for k in range(len(context) - LENGTH + 2):
                window = context[k : k + LENGTH]
                if len(window) == LENGTH and window in seen:
                    since = k if since is None else since
                else:
                    if since is not None:
                        out.append((doc, start + since, start + k - 1 + LENGTH))
                        since = None
                    seen.add(window)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc", "start", "end"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w1, w2, doc, start) of every window of the given contexts."""
    for batch in batches:
        for doc, first, context in zip(*(c.to_pylist() for c in batch.columns)):
            data = np.frombuffer(context, np.uint8)
            start = np.arange(len(data) - LENGTH + 1)
            pair = [h.of(h.load(data), start, start + LENGTH) for h in _hashes()]
            yield pa.RecordBatch.from_arrays(
                [_longs(pair[0]), _longs(pair[1]), pa.array(np.full(len(start), doc, np.int64)), pa.array(start + first)],
                names=["w1", "w2", "doc", "start"],
            )


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(doc, start, end): byte spans covered by strings that also start earlier.

    ``texts`` has a long ``doc``, unique per text, in the order that says what is
    earlier, and ``text`` without nulls.
    """
    keys = ["lead", "context", "doc", "place"]
    buckets = _suffixes(texts).repartitionByRange(*keys).sortWithinPartitions(*keys)
    found = stored(buckets.mapInArrow(_walk, "lead long, doc long, place long, repeated boolean"), "common_suffixes")
    start = F.shiftright("place", 8)
    spans = found.filter("repeated").select("doc", start.alias("start"), (start + F.expr("place & 255") - 1 + LENGTH).alias("end"))
    compare = found.filter("NOT repeated").select("lead", "doc", "place").distinct()
    counts = stored(compare.groupBy("lead").agg(F.count("*").alias("n")).filter("n > 1"), "lead_counts")
    contexts = stored(_contexts(texts, compare.join(counts, "lead")), "contexts")
    few = contexts.filter(F.col("n") <= FEW).select("lead", "doc", "start", "context")
    few = few.repartition("lead").sortWithinPartitions("lead", "doc", "start").mapInArrow(_compare_few, "doc long, start long, end long")
    # A lead with very many contexts is not gathered; its windows meet by their hashes.
    many = contexts.filter(F.col("n") > FEW).select("doc", "start", "context")
    windows = stored(many.mapInArrow(_windows, "w1 long, w2 long, doc long, start long"), "windows")
    firsts = windows.groupBy("w1", "w2").agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("n"))
    firsts = stored(firsts.filter("n > 1").drop("n"), "first_windows")
    later = windows.join(firsts, ["w1", "w2"]).filter(F.struct("doc", "start") != F.col("first"))
    return spans.union(few).union(later.select("doc", "start", (F.col("start") + LENGTH).alias("end")))


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """Texts with a long ``doc``: the id itself where it can serve, else its rank.

    An id can serve when it is a whole number, never null and never given to two texts.
    """
    rows = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    if isinstance(docs.schema[id_col].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        clash = rows.groupBy("id").agg(F.count("*").alias("n"), F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b"))
        if clash.filter("id IS NULL OR a <> b").isEmpty():
            return rows.select(F.col("id").cast("long").alias("doc"), "text"), None
    keyed = rows.withColumn("digest", F.sha2("text", 256))
    order = keyed.select(last(F.col("id")).alias("o"), "digest").distinct().repartitionByRange("o", "digest")
    ranks = stored(order.sortWithinPartitions("o", "digest").withColumn("doc", F.monotonically_increasing_id()), "ranks")
    ranks = ranks.select(F.col("o.value").alias("i"), F.col("digest").alias("g"), "doc")
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("g"))
    numbered = stored(keyed.join(ranks, same).select("id", "doc", "text"), "numbered_texts")
    return numbered.select("doc", "text"), numbered.select("id", "doc")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) per row of ``docs``.

    A byte goes when a string of ``LENGTH`` bytes covers it that also starts earlier: in
    a text with a smaller id, or in the same text. Strings are judged on the texts as
    given, as UTF-8 and each by itself; null counts as the empty text. Rows repeated with
    the same id and text are one text and have equal results; of different texts under
    one id, an order by digest says which is earlier; a null id comes last. An empty
    table gives no rows; other columns are ignored.
    """
    required(docs, id_col, text_col)
    short_batches(docs.sparkSession)
    filtered_scans(docs.sparkSession)
    texts, names = _numbered(docs, id_col, text_col)
    # A text has no more spans than bytes.
    spans = repeated_spans(texts).groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    spans = stored(spans, "spans").filter(F.size("spans") > 0)
    joined = texts.join(spans, "doc").select("doc", "text", "spans.start", "spans.end")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, starts, ends in zip(*(c.to_pylist() for c in batch.columns)):
                data = text.encode()
                edges = np.zeros(len(data) + 1, np.int64)
                np.add.at(edges, np.array(starts), 1)
                np.add.at(edges, np.array(ends), -1)
                gone = np.cumsum(edges[:-1]) > 0
                runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                out.append((doc, int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["doc", "removed", "runs", "left"])

    changed = stored(joined.mapInArrow(run, "doc long, removed long, runs long, left string").distinct(), "changed_texts")
    # Texts without spans need no second look at their bytes.
    plain = texts.select("doc", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("digest"))
    none = F.lit(0).cast("long")
    result = plain.join(changed, "doc", "left").select(
        "doc", "n_bytes", F.coalesce("removed", none).alias("n_removed"), F.coalesce("runs", none).alias("n_spans"),
        F.coalesce("left", "digest").alias("kept_sha256"),
    )
    if names is None:
        kind = docs.schema[id_col].dataType
        return result.withColumn("doc", F.col("doc").cast(kind)).withColumnRenamed("doc", id_col)
    return names.join(result.distinct(), "doc").drop("doc").withColumnRenamed("id", id_col)
