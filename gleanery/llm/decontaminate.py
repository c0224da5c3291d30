"""Benchmark passages in documents, found through an FM-index per shard of documents.

Each task cuts its documents into shards of about ``SHARD_WORDS`` words and indexes every
shard by itself: the suffixes of its word numbers are sorted, the word before each suffix
goes into a wavelet tree, and every ``SAMPLE``-th text position stays with its suffix. The
indexes are a table; any benchmark can be searched in it. A window of benchmark words is
looked up from its last word to its first, one pair of wavelet ranks a word, whatever the
shard's size; the suffixes left are the occurrences, and stepping back to the next sampled
suffix tells their places. Places that overlap are merged to spans.

The benchmark is cut into blocks of bounded bytes; one block at a time meets all shards.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import required, short_batches, whole
from gleanery.session import scratch_path, stored

#: Words of a benchmark item that must stand together in a document.
WINDOW = 10
#: Words in a shard; a longer document is cut into pieces that overlap by a window less one word.
SHARD_WORDS = 1 << 20
#: Every so many places of a text keep their suffix.
SAMPLE = 8
#: Bytes of benchmark that are broadcast at once.
BLOCK_BYTES = 4 << 20

# Words are runs of 0-9, a-z after lower-casing A-Z, and all bytes of characters beyond ASCII.
_WORDS = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_WORDS).split()


def sort_suffixes(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by doubling the depth to which they are compared.

    The text ends with a symbol that stands nowhere else, and so does each piece in it:
    suffixes still tied have further symbols to compare.
    """
    n = len(symbols)
    bits = max(1, int(symbols.max()).bit_length())
    depth = min(n, max(1, 62 // bits))
    key = symbols.astype(np.int64)
    for k in range(1, depth):
        key <<= bits
        key[: n - k] |= symbols[k:]
    order = np.argsort(key)
    key = key[order]
    head = np.empty(n, bool)
    head[0] = True
    np.not_equal(key[1:], key[:-1], out=head[1:])
    # A suffix's rank is the place of the first of those tied with it.
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    tied = ~head
    tied[:-1] |= ~head[1:]
    at = np.flatnonzero(tied)
    while len(at):
        suffix = order[at]
        key = rank[suffix] * n + rank[suffix + depth]
        perm = np.argsort(key)
        key, suffix = key[perm], suffix[perm]
        order[at] = suffix
        head = np.empty(len(at), bool)
        head[0] = True
        np.not_equal(key[1:], key[:-1], out=head[1:])
        rank[suffix] = np.maximum.accumulate(np.where(head, at, 0))
        tied = ~head
        tied[:-1] |= ~head[1:]
        at = at[tied]
        depth *= 2
    return order


class Wavelet:
    """Wavelet tree laid out level by level, highest bit first; zeros before ones on each."""

    def __init__(self, bits: np.ndarray, n: int) -> None:
        self.bits, self.n = bits, n
        self.before = np.zeros((len(bits), bits.shape[1]), np.int64)
        np.cumsum(np.bitwise_count(bits[:, :-1]), axis=1, out=self.before[:, 1:])
        last = bits.shape[1] - 1
        self.zeros = [n - int(b[last] + np.bitwise_count(w[last])) for w, b in zip(bits, self.before)]

    @staticmethod
    def of(symbols: np.ndarray) -> np.ndarray:
        """The bits of all levels, 64 to a number."""
        n, levels = len(symbols), max(1, int(symbols.max(initial=0)).bit_length())
        bits = np.zeros((levels, n // 64 + 1), np.uint64)
        now = symbols.astype(np.uint32)
        for row, level in enumerate(reversed(range(levels))):
            one = (now & np.uint32(1 << level)) != 0
            packed = np.packbits(one, bitorder="little")
            bits[row].view(np.uint8)[: len(packed)] = packed
            now = np.concatenate([now[~one], now[one]])
        return bits

    def ones(self, level: int, i: np.ndarray) -> np.ndarray:
        """How many ones stand before ``i`` on a level."""
        word = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level][word] + np.bitwise_count(self.bits[level][word] & below)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where ``i`` comes to lie at the bottom, going the way of ``symbol``."""
        for row in range(len(self.bits)):
            one = self.ones(row, i)
            i = np.where(symbol >> (len(self.bits) - 1 - row) & 1, self.zeros[row] + one, i - one)
        return i

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at ``i``, and where they come to lie at the bottom."""
        symbol = np.zeros(len(i), np.int64)
        for row in range(len(self.bits)):
            one = self.ones(row, i)
            bit = (self.bits[row][i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)
            symbol = symbol << 1 | bit
            i = np.where(bit, self.zeros[row] + one, i - one)
        return symbol, i


def build_index(pieces: list[np.ndarray], n_words: int) -> dict[str, np.ndarray]:
    """The index of pieces of word numbers, each followed by an end of its own."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    ends = starts + sizes
    text = np.zeros(int(ends[-1]) + 1, np.int64)
    for start, piece in zip(starts, pieces):
        text[start : start + len(piece)] = piece
    word = np.ones(len(text), bool)
    word[ends] = False
    # For sorting, each end is a symbol of its own; in the tree all are symbol 0.
    symbols = text + len(pieces)
    symbols[ends] = np.arange(len(pieces))
    order = sort_suffixes(symbols)
    text += 1
    text[ends] = 0
    before = text[order - 1]
    counts = np.bincount(text, minlength=n_words + 1)
    first = np.cumsum(counts) - counts
    # The bottom of the tree holds the symbols in the order of their reversed bits.
    levels = max(1, int(before.max()).bit_length())
    turned, number = np.zeros(n_words + 1, np.int64), np.arange(n_words + 1)
    for _ in range(levels):
        turned, number = turned << 1 | number & 1, number >> 1
    by_turned = np.argsort(turned)
    bottom = np.empty(n_words + 1, np.int64)
    bottom[by_turned] = np.cumsum(counts[by_turned]) - counts[by_turned]
    # The first word of a piece is sampled too, so no step leads over an end.
    sampled = order % SAMPLE == 0
    begin = np.zeros(len(text), bool)
    begin[starts] = True
    sampled |= begin[order]
    return {
        "tree": Wavelet.of(before),
        "shift": (first - bottom).astype(np.int32),
        "sampled": Wavelet.of(sampled.astype(np.int64)),
        "places": order[sampled].astype(np.int32),
        "starts": starts.astype(np.int32),
    }


class Index:
    """A shard's index, as read from the table."""

    def __init__(self, row: dict) -> None:
        numbers = lambda name, kind: np.frombuffer(row[name], kind)
        self.n = row["n"]
        width = self.n // 64 + 1
        self.tree = Wavelet(numbers("tree", np.uint64).reshape(-1, width), self.n)
        self.sampled = Wavelet(numbers("sampled", np.uint64).reshape(-1, width), self.n)
        self.shift = numbers("shift", np.int32).astype(np.int64)
        self.places = numbers("places", np.int32).astype(np.int64)
        self.starts = numbers("starts", np.int32).astype(np.int64)
        self.number = {w: k for k, w in enumerate(row["vocabulary"].split(b" "), 1)} if row["vocabulary"] else {}

    def find(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of windows (rows of symbols, 0 for a word the shard lacks)."""
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), self.n)
        alive = np.flatnonzero((windows > 0).all(1))
        high[(windows == 0).any(1)] = 0
        for k in reversed(range(windows.shape[1])):
            symbol = windows[alive, k]
            both = self.tree.rank(np.tile(symbol, 2), np.concatenate([low[alive], high[alive]]))
            both += self.shift[np.tile(symbol, 2)]
            low[alive], high[alive] = both[: len(alive)], both[len(alive) :]
            alive = alive[low[alive] < high[alive]]
        return low, high

    def locate(self, suffix: np.ndarray) -> np.ndarray:
        """Text places of suffixes."""
        place, open_, steps = np.empty(len(suffix), np.int64), np.arange(len(suffix)), 0
        while len(open_):
            known, _ = self.sampled.access(suffix)
            known = known.astype(bool)
            place[open_[known]] = self.places[self.sampled.ones(0, suffix[known])] + steps
            open_, suffix = open_[~known], suffix[~known]
            symbol, bottom = self.tree.access(suffix)
            suffix, steps = bottom + self.shift[symbol], steps + 1
        return place


_INDEX = "n long, tree binary, shift binary, sampled binary, places binary, starts binary, vocabulary binary"


def index_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per shard: its index, and per piece its row, id, first word and number of words.

    A row of ``docs`` is a number of its own, so that null and repeated ids stay apart.
    The table is written; the same rows can be searched again and again.
    """
    required(docs, id_col, text_col)
    short_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, at = TaskContext.get().partitionId() << 40, 0
        number, pieces, about, id_type = defaultdict(count().__next__), [], [], pa.string()

        def shard() -> pa.RecordBatch:
            index = build_index(pieces, len(number))
            rows, ids, firsts, sizes = zip(*about)
            columns = {
                "n": pa.array([sum(map(len, pieces)) + len(pieces)], pa.int64()),
                **{k: pa.array([v.tobytes()], pa.binary()) for k, v in index.items()},
                "vocabulary": pa.array([b" ".join(number)], pa.binary()),
                "rows": pa.array([list(rows)], pa.list_(pa.int64())),
                "ids": pa.array([list(ids)], pa.list_(id_type)),
                "firsts": pa.array([list(firsts)], pa.list_(pa.int64())),
                "sizes": pa.array([list(sizes)], pa.list_(pa.int64())),
            }
            return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        held = 0
        for batch in batches:
            id_type = batch.column(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(text.as_py())
                for first in range(0, max(1, len(words) - WINDOW + 1), shard_words - WINDOW + 1):
                    piece = words[first : first + shard_words]
                    if pieces and held + len(piece) > shard_words:
                        yield shard()
                        number, pieces, about, held = defaultdict(count().__next__), [], [], 0
                    pieces.append(np.fromiter(map(number.__getitem__, piece), np.int64, len(piece)))
                    about.append((row + at, doc, first, len(piece)))
                    held += len(piece) + 1
                at += 1
        if pieces:
            yield shard()

    about = f"rows array<long>, ids array<{kind}>, firsts array<long>, sizes array<long>"
    return stored(docs.select(id_col, whole(text_col)).mapInArrow(run, f"{_INDEX}, {about}"), "shard_indexes")


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> tuple[DataFrame, int]:
    """(block, items): the benchmark's distinct items in blocks of at most ``block_bytes``.

    A single item above the limit is a block of its own, or shares one with small ones.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    items = stored(items.filter("text IS NOT NULL").distinct().withColumn("size", F.octet_length("text").cast("long")), "benchmark")
    total, longest = items.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    blocks = max(1, -(-total // block_bytes))
    while True:
        dealt = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
        largest = dealt.groupBy("block").agg(F.sum("size").alias("size")).agg(F.max("size")).first()[0] or 0
        if largest <= max(block_bytes, 2 * longest):
            return stored(dealt.groupBy("block").agg(F.collect_list(F.struct("item", "text")).alias("items")), "benchmark_blocks"), blocks
        blocks *= 2


class _Windows:
    """The distinct windows of a block, by length, with the items that hold them."""

    def __init__(self, items: list[dict]) -> None:
        self.names = [i["item"] for i in items]
        self.words: dict[bytes, int] = defaultdict(count(1).__next__)
        holders: dict[int, dict[tuple, set]] = defaultdict(lambda: defaultdict(set))
        for k, item in enumerate(items):
            numbers = [self.words[w] for w in words_of(item["text"])]
            size = min(len(numbers), WINDOW)
            for at in range(len(numbers) - size + 1 if numbers else 0):
                holders[size][tuple(numbers[at : at + size])].add(k)
        self.by_size = {}
        for size, found in holders.items():
            counts = np.array([len(x) for x in found.values()])
            flat = np.array([k for x in found.values() for k in sorted(x)], np.int64)
            self.by_size[size] = np.array(list(found), np.int64).reshape(-1, size), counts, np.cumsum(counts) - counts, flat

    def hits(self, index: Index) -> tuple[np.ndarray, ...]:
        """Merged spans (piece, from, to) and distinct (piece, item) of a shard."""
        symbol = np.array([0, *(index.number.get(w, 0) for w in self.words)], np.int64)
        begins, ends, pairs = [], [], []
        for size, (windows, counts, firsts, flat) in self.by_size.items():
            low, high = index.find(symbol[windows])
            times = high - low
            which = np.repeat(np.arange(len(windows)), times)
            suffix = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times) + low[which]
            begin = index.locate(suffix)
            piece = np.searchsorted(index.starts, begin, "right") - 1
            begins.append(begin)
            ends.append(begin + size)
            once = np.unique(piece * len(windows) + which)
            piece, which = once // len(windows), once % len(windows)
            many = counts[which]
            inner = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            pairs.append(np.unique(np.repeat(piece, many) * len(self.names) + flat[np.repeat(firsts[which], many) + inner]))
        begin, end, pair = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (begins, ends, pairs))
        by_begin = np.argsort(begin, kind="stable")
        begin, end = begin[by_begin], np.maximum.accumulate(end[by_begin])
        # Between two pieces stands an end, so a span never reaches into the next piece.
        new = np.ones(len(begin), bool)
        new[1:] = begin[1:] > end[:-1]
        head = np.flatnonzero(new)
        begin, end = begin[head], end[np.append(head[1:], len(end)) - 1] if len(head) else end
        piece = np.searchsorted(index.starts, begin, "right") - 1
        offset = index.starts[piece]
        pair = np.unique(pair)
        return piece, begin - offset, end - offset, pair // max(1, len(self.names)), pair % max(1, len(self.names))


def _lists(owner: np.ndarray, n: int, values: pa.Array) -> pa.ListArray:
    """``values``, which ascend by ``owner``, as one list per owner 0 to n-1."""
    edges = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), values)


def search(index: DataFrame, benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(row, id, n_words, n_hit, spans, items) per indexed document: merged spans of words [from, to).

    Null, empty or wordless items have no window; items repeated under one id are one
    item with both texts; an item without an id marks words but is not named.
    """
    required(benchmark, item_col, text_col)
    blocks, n_blocks = _blocks(benchmark, item_col, text_col, block_bytes)
    id_field = index.schema["ids"].dataType.elementType.simpleString()
    columns = ["n", "tree", "shift", "sampled", "places", "starts", "vocabulary", "rows", "ids", "firsts", "sizes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = None
        for batch in batches:
            items = batch.column("items")
            for k in range(batch.num_rows):
                windows = windows or _Windows(items[k].as_py() or [])
                row = {c: batch.column(c)[k].as_py() for c in columns[:7]}
                rows, ids, firsts, sizes = (batch.column(c)[k].values for c in columns[7:])
                piece, begin, end, in_piece, item = windows.hits(Index(row))
                first = firsts.to_numpy()[piece]
                n = len(rows)
                fields = [pa.array(begin + first), pa.array(end + first)]
                names = pa.array(windows.names, pa.string()).take(pa.array(item))
                # Words that an earlier piece of the document has are not counted again.
                fresh = sizes.to_numpy() - np.where(firsts.to_numpy() > 0, WINDOW - 1, 0)
                spans = _lists(piece, n, pa.StructArray.from_arrays(fields, names=["from", "to"]))
                yield pa.RecordBatch.from_arrays(
                    [rows, ids, pa.array(fresh), spans, _lists(in_piece, n, names)], names=["row", "id", "n_words", "spans", "items"]
                )

    kinds = f"row long, id {id_field}, n_words long, spans array<struct<from:long,to:long>>, items array<string>"
    spark, path = index.sparkSession, scratch_path(index.sparkSession, "block_hits")
    for block in range(n_blocks):
        # One block at a time, of bounded bytes.
        one = F.broadcast(blocks.filter(F.col("block") == block).select("block", "items"))
        met = index.withColumn("block", F.lit(block).cast("long")).join(one, "block", "left").select(*columns, "items")
        here = met.mapInArrow(run, kinds)
        if block:
            # All documents and their words come with the first block.
            here = here.filter(F.size("spans") > 0).withColumn("n_words", F.lit(0).cast("long"))
        here.write.mode("append").parquet(path)
    found = spark.read.schema(here.schema).parquet(path)
    lists = found.groupBy("row").agg(
        F.first("id").alias("id"), F.sum("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    kinds = f"row long, id {id_field}, n_words long, n_hit long, spans array<struct<from:long,to:long>>, items array<string>"
    return lists.mapInArrow(_merge, kinds)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join the spans of a document that overlap or touch: other blocks and pieces find their own."""
    for batch in batches:
        lists = batch.column("spans")
        sizes = np.diff(lists.offsets.to_numpy())
        owner = np.repeat(np.arange(len(lists)), sizes)
        spans = lists.flatten()
        # Documents are set apart by more words than a text can hold.
        begin, end = (spans.field(f).to_numpy(zero_copy_only=False).astype(np.int64) + (owner << 40) for f in ("from", "to"))
        end = np.maximum.accumulate(end)
        new = np.ones(len(begin), bool)
        new[1:] = begin[1:] > end[:-1]
        head = np.flatnonzero(new)
        begin, owner = begin[head], owner[head]
        end = end[np.append(head[1:], len(end)) - 1] if len(head) else end
        hit = np.bincount(owner, end - begin, len(lists)).astype(np.int64)
        fields = [pa.array(begin - (owner << 40)), pa.array(end - (owner << 40))]
        merged = _lists(owner, len(lists), pa.StructArray.from_arrays(fields, names=["from", "to"]))
        columns = [batch.column("row"), batch.column("id"), batch.column("n_words"), pa.array(hit), merged, batch.column("items")]
        yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "n_words", "n_hit", "spans", "items"])


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated, spans, items) per row of ``docs``.

    A word is hit inside any occurrence of ``WINDOW`` consecutive words of an item; an item
    of fewer words is one window. Letters A-Z count as a-z. A null or empty text has no
    words; repeated rows and ids each give their row; an empty table gives no rows, an
    empty benchmark no hits; further columns of either table are ignored.
    """
    found = search(index_shards(docs, id_col, text_col), benchmark)
    return found.select(
        F.col("id").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
        "spans", "items",
    )


def cut_spans(text: str, spans: list[dict]) -> str:
    """``text`` without the given spans of words, each cut from its first to its last byte."""
    data = text.encode()
    kept = np.frombuffer(data.translate(_WORDS), np.uint8) != 0x20
    edge = np.diff(np.concatenate([[0], kept.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out, at = [], 0
    for s in spans:
        out.append(data[at : starts[s["from"]]])
        at = ends[s["to"] - 1]
    return b"".join([*out, data[at:]]).decode()


ORACLE_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS phrase
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS k FROM bw WHERE len(w) > 0)),
places AS (
  SELECT doc_id, size, k, array_to_string(w[k : k + size - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM dw, (SELECT DISTINCT size FROM windows))),
found AS (SELECT doc_id, item, p.size, k FROM places p JOIN windows USING (size, phrase)),
hit AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(k, k + size)) AS place FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM found GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(named.n, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, hit.n IS NOT NULL AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
