"""Near-duplicate documents by bottom-k sketches.

One hash function maps each word shingle to a number, and a document's sketch is its k
smallest. Inverted lists of the retained values give the pairs that overlap. The k
smallest values of two sketches together estimate the similarity of the pair and sift
out most; the remaining pairs are decided on their full sets.

Documents that meet in long lists, as those of a large family of near copies do, are
listed anew by their full sets, under the few values that a partner of a given size must
share one of (prefix filtering, Bayardo et al. 2007, Xiao et al. 2008).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm import links
from gleanery.llm.common import filtered_scans, fresh, required, short_batches
from gleanery.session import stored

#: Values a sketch retains.
RETAINED = 32
#: A pair is dropped unverified only when the estimate is below this share. A pair with
#: similarity 0.8 falls below it with probability under 1e-6 (13 of 32 draws).
SIFT_PERCENT = 40
#: Set sizes are listed in classes this factor wide.
SIZE_CLASS = 1.02
#: Words remembered by a worker.
REMEMBERED = 100_000

_MASK = (1 << 64) - 1


class _Words(dict):
    """64-bit numbers of words."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = xxhash.xxh3_64_intdigest(word)
        return number


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, width: int, words: _Words) -> np.ndarray:
    """Sorted distinct 64-bit numbers of the shingles of one text, as signed longs."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.int64)
    if len(words) > REMEMBERED:
        words.clear()
    at = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    size = min(width, len(at))
    total = np.zeros(len(at) - size + 1, np.uint64)
    for k in range(size):
        factor = np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1)
        total += at[k : k + len(total)] * factor
    # A shorter sequence is one shingle of its own kind.
    return np.unique(_mixed(total + np.uint64(size)).view(np.int64))


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc_id, n_shingles, print, sketch): set size, digest of the set, retained values."""
    short_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            sizes, prints, kept = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                values = shingle_set(text or b"", width, words)
                sizes.append(len(values))
                prints.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest())
                kept.append(values[:RETAINED])
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(kept, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "print", "sketch"])

    schema = f"doc_id {kind}, n_shingles long, print binary, sketch array<long>"
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, set) of the wanted ids; a set is its sorted longs."""
    filtered_scans(docs.sparkSession)
    # Naming the range of a stored count tells Spark that the ids are few.
    chosen = stored(wanted.withColumn("one", F.lit(1)), "wanted_ids").filter("one > 0")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id", "left_semi")
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            sets = [shingle_set(t or b"", width, words) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "set"])

    return texts.mapInArrow(run, f"id {kind}, set array<long>")


def _by_prefix(sets: DataFrame, percent: int) -> DataFrame:
    """(key, id, rank, own): the keys of which two linked sets have one in common.

    Of sets with m <= n values linked at similarity t, t / (1 + t) * (m + n) are shared.
    With the values of both ordered from the rarest on, they share one of the first
    n - that many + 1 of the larger set. A set is listed for every class of sizes m that
    a smaller partner may have, and is ``own`` in its own class. Sets close to most of
    their list, which is what the original of many copies is, have the lowest rank.
    """
    values = sets.select("id", F.size("set").alias("size"), F.explode("set").alias("value"))
    shared = stored(values.groupBy("value").agg(F.count("*").alias("n")).filter("n > 1"), "shared_values")
    found = values.join(shared, "value").groupBy("id", "size").agg(F.array_sort(F.collect_list(F.struct("n", "value"))).alias("found"))
    kind = sets.schema["id"].dataType.simpleString()
    share = percent / (100 + percent)
    # A class is taken by its lower bound, and rounding must not make it larger.
    level = lambda size: int(math.log(size) / math.log(SIZE_CLASS) + 1e-9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for id_, size, pairs in zip(*(batch.column(k).to_pylist() for k in range(3))):
                values = np.array([p["value"] for p in pairs], np.int64)
                rank, alone = -sum(p["n"] for p in pairs), size - len(pairs)
                least = -(-size * percent // 100)
                keys, own = [], []
                for c in range(level(least), level(size) + 1):
                    smaller = max(math.ceil(SIZE_CLASS**c - 1e-6), least)
                    take = size - math.ceil(share * (size + smaller) - 1e-6) + 1 - alone
                    if take > 0:
                        mark = np.uint64((c + 1) * 0x9E3779B97F4A7C15 & _MASK)
                        keys.append(_mixed(values[:take].view(np.uint64) ^ mark).view(np.int64))
                        own.append(np.full(len(keys[-1]), c == level(size)))
                if keys:
                    keys, own = np.concatenate(keys), np.concatenate(own)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys), pa.array([id_] * len(keys), batch.column(0).type), pa.array(np.full(len(keys), rank)), pa.array(own)],
                        names=["key", "id", "rank", "own"],
                    )

    return found.select("id", "size", "found").mapInArrow(run, f"key long, id {kind}, rank long, own boolean").distinct()


def _rarest(items: DataFrame) -> DataFrame:
    """(key, id): the retained values that a linked partner must share one of.

    A linked pair shares at least SIFT_PERCENT of its retained values. Ordered from the
    rarest on, the same way for all, two such sketches share a value already in the part
    that leaves out just less than that many. So the values of a passage that very many
    documents have generate no pairs for documents with enough other text.
    """
    entries = items.select("id", F.explode("sketch").alias("key")).distinct()
    sizes = stored(entries.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "value_counts")
    shared = entries.join(sizes, "key").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("found"))
    retained = F.size("sketch")
    take = retained - F.ceil(retained * SIFT_PERCENT / 100) + 1 - (retained - F.size("found"))
    # Values that nobody else has come first and take their places.
    rare = shared.join(items.select("id", "sketch"), "id").withColumn("take", take.cast("int")).filter("take > 0")
    return rare.select("id", F.explode(F.slice("found", F.lit(1), F.col("take"))).alias("f")).select("f.key", "id").distinct()


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """(id, n_shingles, component_id, kept) per row of ``docs``.

    Two documents are linked when ``100 * |A and B| >= percent * |A or B|`` for their
    sets of lower-cased ``width``-word shingles; with fewer words the whole sequence is
    the one shingle. ``component_id`` is the smallest id reachable over links and only
    that row is kept. Texts without words, and null, are linked with nothing. A row
    without an id cannot be named by others: its component is null and it is kept. Rows
    repeated under one id are one document; with different texts each row takes the
    smaller of its set's component and its id's. An empty table gives no rows; other
    columns are ignored.
    """
    required(docs, id_col, text_col)
    drawn = stored(sketches(docs, id_col, text_col, width), "sketches")
    usable = drawn.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    # Equal sets are one item from here on; their rows take its component at the end.
    items = stored(usable.groupBy("print").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies")), "equal_sets")
    joined = usable.join(items, "print").filter(F.col("doc_id") == F.col("id"))
    # A repeated row would stand here twice.
    unique = stored(joined.select("id", "n_shingles", "sketch").distinct(), "items")

    near = links.lists(_rarest(unique))
    crowded = stored(near.filter(F.col("n") > links.SHORT).select("id").distinct(), "crowded")

    def sift(pairs: DataFrame) -> DataFrame:
        left = unique.select(F.col("id").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa"))
        right = unique.select(F.col("id").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb"))
        both = pairs.join(left, "a").join(right, "b")
        both = both.filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
        union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, RETAINED)
        both = both.withColumn("u", union)
        shared = F.size(F.array_intersect(F.array_intersect("u", "sa"), F.col("sb")))
        return both.filter(shared * 100 >= F.size("u") * SIFT_PERCENT).select("a", "b")

    first = stored(sift(links.candidates(near.filter(F.col("n") <= links.SHORT))), "sifted")
    wanted = first.select(F.col("a").alias("id")).union(first.select("b")).union(crowded).distinct()
    sets = stored(_full_sets(docs, wanted, id_col, text_col, width), "full_sets")

    def confirm(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("id").alias("a"), F.col("set").alias("left"))
        right = sets.select(F.col("id").alias("b"), F.col("set").alias("right"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                true = []
                for x, y in zip(batch.column(2), batch.column(3)):
                    both = np.concatenate([x.values.to_numpy(), y.values.to_numpy()])
                    both.sort()
                    shared = int((both[1:] == both[:-1]).sum())
                    true.append(100 * shared >= percent * (len(both) - shared))
                yield batch.select([0, 1]).filter(pa.array(true, pa.bool_()))

        kind = sets.schema["id"].dataType.simpleString()
        both = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
        return both.mapInArrow(run, f"a {kind}, b {kind}").distinct()

    family = links.lists(_by_prefix(sets.join(crowded, "id", "left_semi"), percent))
    verify = lambda pairs: confirm(stored(sift(pairs), "sifted"))
    true = confirm(first).union(verify(links.candidates(family)))
    groups = links.settle(family, stored(true, "true_links"), verify)

    named = items.join(groups, F.col("id") == F.col("node"), "left").select(
        "print", F.coalesce("component", "id").alias("component_id")
    )
    found = drawn.join(stored(named, "named_sets"), "print", "left")
    own = F.col("doc_id")
    component = F.when(own.isNull() | (F.col("n_shingles") == 0), own).otherwise(F.col("component_id"))
    # An id with several texts may stand in a component through another of them.
    return _by_id(found.select("doc_id", "n_shingles", component.alias("component_id")), groups).select(
        own.alias(id_col), "n_shingles", "component_id",
        (own.isNull() | (own == F.col("component_id"))).alias("kept"),
    )


def _by_id(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Give every row the least component known for its id."""
    other = groups.select(F.col("node").alias("doc_id"), F.col("component").alias("by_id"))
    return rows.join(other, "doc_id", "left").select(
        "doc_id", "n_shingles", F.least("component_id", "by_id").alias("component_id")
    )


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each group, with all their columns."""
    mine = fresh(docs, "near_id")
    kept = stored(near_copies(docs, id_col, text_col, width, percent).filter("kept").select(F.col(id_col).alias(mine)), "kept_ids")
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col(mine)), "left_semi")
