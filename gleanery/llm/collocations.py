"""Phrases whose words stand together more often than their parts would let expect.

Phrases are counted in a HAT-trie per task and language: a shallow trie over word numbers
whose leaves are hash containers of packed phrases. A container that outgrows its limit
bursts into containers of its own, first by the first word, then by the second. Where a
task holds too many phrases, its largest subtrees are spilled whole, as sorted runs.

Runs are cut by a hash of the first two words, so that every phrase and all that begin
like it meet in one prefix partition; there the runs are merged and rare phrases end.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import required, short_batches, whole
from gleanery.session import stored

#: Phrases that occur less often are no candidates.
LEAST = 10
#: Phrases reported per language.
TOP = 2000
#: A longer candidate with so many percent of a phrase's occurrences stands for it.
COVERED = 50

#: Distinct phrases in a container before it bursts, and into how many.
BURST = 1 << 17
PARTS = 16
#: Distinct phrases and distinct words that a task holds before it spills.
MOST_PHRASES = 4 << 20
MOST_WORDS = 1 << 20
#: Bytes of text that are counted at once.
SEGMENT = 4 << 20

# Packed phrases differ in few bits, so the hash tables get them mixed, in a way that can be undone.
_SPREAD = 0x9E3779B97F4A7C15
_GATHER = pow(_SPREAD, -1, 1 << 64)
# Three word numbers of 21 bits make a key; 0 stands for no word.
_BITS = 21
_WORD = (1 << _BITS) - 1
# What ends a piece becomes a line feed, what parts words a space, A-Z become a-z.
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else 0x0A if c in b".,;:!?\n\v\f\r" else 0x20 if c == 0x09 else c for c in range(256))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    order = np.argsort(keys)
    keys = keys[order]
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[head], np.add.reduceat(counts[order], head) if len(head) else counts[:0]


def _spread(keys: np.ndarray) -> np.ndarray:
    mixed = keys.view(np.uint64) * np.uint64(_SPREAD)
    return (mixed ^ mixed >> np.uint64(32)).view(np.int64)


def _gather(keys: np.ndarray) -> np.ndarray:
    mixed = keys.view(np.uint64)
    return ((mixed ^ mixed >> np.uint64(32)) * np.uint64(_GATHER)).view(np.int64)


class Container:
    """A leaf: a hash table of phrases, with those of the last batches still to enter it."""

    def __init__(self) -> None:
        self.table = pa.table({"k": pa.array([], pa.int64()), "c": pa.array([], pa.int64())})
        self.waiting: list[pa.Table] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append(pa.table({"k": _spread(keys), "c": counts}))
        self.size += len(keys)
        if self.size > 2 * max(BURST // 4, self.table.num_rows):
            self.enter()

    def enter(self) -> None:
        if self.waiting:
            both = pa.concat_tables([self.table, *self.waiting])
            self.table = both.group_by("k", use_threads=False).aggregate([("c", "sum")]).rename_columns(["k", "c"])
            self.waiting = []
        self.size = self.table.num_rows

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        self.enter()
        return _gather(self.table.column("k").to_numpy()), self.table.column("c").to_numpy()


class Trie:
    """A node: children by ranges of prefixes, each a container or a node further down."""

    def __init__(self) -> None:
        self.cuts = np.array([0], np.int64)
        self.children: list[Container | Trie] = [Container()]

    @property
    def size(self) -> int:
        return sum(c.size for c in self.children)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Count distinct keys, given in order."""
        edges = [*np.searchsorted(keys, self.cuts), len(keys)]
        for k in reversed(range(len(self.children))):
            if edges[k] < edges[k + 1]:
                child = self.children[k]
                child.add(keys[edges[k] : edges[k + 1]], counts[edges[k] : edges[k + 1]])
                if isinstance(child, Container) and child.size > BURST:
                    child.enter()
                    if child.size > BURST:
                        self._burst(k)

    def _burst(self, k: int) -> None:
        keys, counts = self.children[k].entries()
        keys, counts = summed(keys, counts)
        at = np.linspace(0, len(keys), PARTS, endpoint=False).astype(np.int64)
        for words in (1, 2):
            # Cut between first words; where all share one, between second words.
            rest = _BITS * (3 - words)
            cuts = np.unique(keys[at] >> rest << rest)
            cuts[0] = self.cuts[k]
            if len(cuts) > 1:
                node = Trie()
                node.cuts, node.children = cuts, [Container() for _ in cuts]
                node.add(keys, counts)
                self.children[k] = node
                return

    def leaves(self) -> Iterator[tuple[Trie, int]]:
        for k, child in enumerate(self.children):
            if isinstance(child, Trie):
                yield from child.leaves()
            else:
                yield self, k

    def take(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Spill the largest subtrees, until at most ``most`` phrases are left."""
        keys, counts, left = [], [], self.size
        for node, k in sorted(self.leaves(), key=lambda x: -x[0].children[x[1]].size):
            if left <= most:
                break
            left -= node.children[k].size
            taken = node.children[k].entries()
            node.children[k] = Container()
            keys.append(taken[0])
            counts.append(taken[1])
        none = np.zeros(0, np.int64)
        return summed(np.concatenate([none, *keys]), np.concatenate([none, *counts]))


def segments(data: bytes) -> Iterator[tuple[list[bytes], int]]:
    """Tokens of a text in lots of bounded bytes, with how many were in the lot before.

    A token is a word, or a line feed at the end of a piece. A lot that ends inside a
    piece hands its last two tokens on.
    """
    data, at, carried = data.translate(_TABLE), 0, []
    while at < len(data):
        to = len(data)
        if to - at > SEGMENT:
            to = data.rfind(b"\n", at, at + SEGMENT) + 1
            to = to or data.rfind(b" ", at, at + SEGMENT) + 1
            to = to or data.find(b" ", at) + 1 or len(data)
        tokens = carried + [t for t in data[at:to].replace(b"\n", b" \n ").split(b" ") if t]
        yield tokens, len(carried)
        carried, at = tokens[-2:], to


def phrases(words: np.ndarray, carried: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct packed phrases of one to three words and their counts; 0 ends a piece."""
    found, key = [], words << 2 * _BITS
    one = words > 0
    found.append(key[carried:][one[carried:]])
    if len(words) > 1:
        ok = one[:-1] & one[1:]
        two = key[:-1] | words[1:] << _BITS
        first = max(0, carried - 1)
        found.append(two[first:][ok[first:]])
        if len(words) > 2:
            three = (two[:-1] | words[2:])[ok[:-1] & one[2:]]
            # Two carried words are the most, so a phrase of three always ends in this lot.
            found.append(three)
    keys = np.sort(np.concatenate(found))
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[head], np.diff(np.append(head, len(keys)))


_RUN = pa.schema([("part", pa.int32()), ("lang", pa.string()), ("words", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary())])


def _runs(lang: str, vocabulary: list[bytes], hashes: np.ndarray, keys: np.ndarray, counts: np.ndarray, parts: int) -> Iterator[tuple]:
    """One sorted run per prefix partition, over the run's own words in order."""
    if not len(keys):
        return
    first, second = keys >> 2 * _BITS, keys >> _BITS & _WORD
    mixed = hashes[first] * np.uint64(0x9E3779B97F4A7C15) + np.where(second > 0, hashes[second], 0).astype(np.uint64)
    mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(zlib.crc32(lang.encode()))
    part = ((mixed ^ mixed >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)
    by_part = np.argsort(part, kind="stable")
    keys, counts, part = keys[by_part], counts[by_part], part[by_part]
    edges = [*np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])), len(part)]
    pack = zstandard.ZstdCompressor(level=1)
    for a, b in zip(edges, edges[1:]):
        columns = np.stack([keys[a:b] >> 2 * _BITS, keys[a:b] >> _BITS & _WORD, keys[a:b] & _WORD])
        used = np.unique(columns)
        used = used[used > 0].tolist()
        used.sort(key=vocabulary.__getitem__)
        number = np.zeros(max(used) + 1, np.int64)
        number[used] = np.arange(1, len(used) + 1)
        one, two, three = number[columns]
        own = one << 2 * _BITS | two << _BITS | three
        order = np.argsort(own)
        # Steps between sorted keys, their bytes turned, are mostly zeros.
        steps = np.diff(own[order], prepend=0).view(np.uint8).reshape(-1, 8).T.tobytes()
        amounts = counts[a:b][order].astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes()
        words = b" ".join(vocabulary[u] for u in used)
        yield int(part[a]), lang, *(pack.compress(x) for x in (words, steps, amounts))


def _read(run: dict) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    unpack = zstandard.ZstdDecompressor()
    words, steps, amounts = (unpack.decompress(run[c]) for c in ("words", "keys", "counts"))
    longs = lambda x: np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view(np.int64).ravel()
    return words.split(b" "), np.cumsum(longs(steps)), longs(amounts)


def _count(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[str, Trie] = defaultdict(Trie)
        number = defaultdict(count().__next__)
        number[b"\n"]  # 0 ends a piece

        def spill(most: int) -> Iterator[pa.RecordBatch]:
            total, words = sum(t.size for t in tries.values()), list(number)
            hashes = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
            for lang, trie in tries.items():
                keys, counts = trie.take(int(trie.size * most / max(total, 1)))
                for one in _runs(lang, words, hashes, keys, counts, parts):
                    yield pa.RecordBatch.from_pylist([dict(zip(_RUN.names, one))], _RUN)

        for batch in batches:
            by_lang = defaultdict(list)
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_lang[lang].append(text.encode())
            for lang, texts in by_lang.items():
                for tokens, carried in segments(b"\n".join(texts)):
                    words = np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens))
                    tries[lang].add(*phrases(words, carried))
                    if len(number) > MOST_WORDS:
                        yield from spill(0)
                        tries.clear()
                        number = defaultdict(count().__next__)
                        number[b"\n"]
                    elif sum(t.size for t in tries.values()) > MOST_PHRASES:
                        yield from spill(MOST_PHRASES // 2)
        yield from spill(0)

    return run


def _merge(least: int):
    """Merge the runs of each prefix partition, which come together and in order."""

    def merged(lang: str, runs: list[tuple]) -> pa.RecordBatch:
        words = sorted({w for own, _, _ in runs for w in own})
        place = {w: k for k, w in enumerate(words, 1)}
        all_keys = []
        for own, keys, _ in runs:
            # The words of a run are in order, so its keys stay in order.
            number = np.array([0, *map(place.__getitem__, own)], np.int64)
            all_keys.append(number[keys >> 2 * _BITS] << 2 * _BITS | number[keys >> _BITS & _WORD] << _BITS | number[keys & _WORD])
        keys, counts = summed(np.concatenate(all_keys), np.concatenate([c for _, _, c in runs]))
        alone = keys & ((1 << 2 * _BITS) - 1) == 0
        total = int(counts[alone].sum())
        often = counts >= least
        keys, counts = keys[often], counts[often]
        names = pa.array([None, *(w.decode() for w in words)], pa.string())
        columns = [names.take(pa.array(np.append(x, 0))) for x in (keys >> 2 * _BITS, keys >> _BITS & _WORD, keys & _WORD)]
        # The last row has no word: it counts all words.
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * (len(keys) + 1), pa.string()), *columns, pa.array(np.append(counts, total))], names=["lang", "w1", "w2", "w3", "f"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, runs = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if (row["part"], row["lang"]) != at:
                    if runs:
                        yield merged(at[1], runs)
                    at, runs = (row["part"], row["lang"]), []
                runs.append(_read(row))
        if runs:
            yield merged(at[1], runs)

    return run


def phrase_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, parts: int | None = None) -> DataFrame:
    """(lang, w1, w2, w3, f) of phrases of one to three words that occur ``least`` times or more.

    Rows without words carry the number of all words of a language, in parts to be added.
    """
    spark = docs.sparkSession
    short_batches(spark)
    parts = parts or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    runs = docs.select(lang, whole(text_col)).mapInArrow(_count(parts), "part int, lang string, words binary, keys binary, counts binary")
    dealt = runs.repartition(parts, "part").sortWithinPartitions("part", "lang")
    return stored(dealt.mapInArrow(_merge(least), "lang string, w1 string, w2 string, w3 string, f long"), "phrase_counts")


def _score(a: str, left: str, right: str) -> Column:
    exact = "DECIMAL(14, 0)"
    product = f"CAST(1000000 AS DECIMAL(7, 0)) * CAST({a} AS {exact}) * CAST({a} AS {exact})"
    return F.expr(f"({product}) DIV (CAST({left} AS {exact}) * CAST({right} AS {exact}))")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases.

    Letters A-Z count as a-z; phrases stay within pieces between ``. , ; : ! ?`` and line
    ends. A phrase scores as its weakest cut into two parts. Scores are exact up to 10^14
    occurrences. A null language is ``und``, a null or empty text has no words; repeated
    rows count as often as they stand there; an empty table gives no rows; ties end by the
    phrase's bytes; other columns are ignored.
    """
    required(docs, lang_col, text_col)
    counts = phrase_counts(docs, lang_col, text_col, least)
    totals = counts.filter("w1 IS NULL").groupBy("lang").agg(F.sum("f").alias("n"))
    ones = counts.filter("w1 IS NOT NULL AND w2 IS NULL").select("lang", F.col("w1").alias("x1"), F.col("f").alias("fx"))
    twos = counts.filter("w2 IS NOT NULL AND w3 IS NULL").select("lang", "w1", "w2", F.col("f").alias("a"))
    threes = counts.filter("w3 IS NOT NULL").select("lang", "w1", "w2", "w3", F.col("f").alias("a"))
    # Parts of a candidate occur at least as often as the candidate, so all are there.
    head = ones.select("lang", F.col("x1").alias("w1"), F.col("fx").alias("f1"))
    pair = twos.select("lang", F.col("w1").alias("p1"), F.col("w2").alias("p2"), F.col("a").alias("fp"))

    def cut(left: str, right: str) -> Column:
        return F.struct(_score("a", left, right).alias("score"), F.col(left).alias("l"), F.col(right).alias("r"))

    second = ones.select("lang", F.col("x1").alias("w2"), F.col("fx").alias("f2"))
    scored_twos = twos.join(head, ["lang", "w1"]).join(second, ["lang", "w2"])
    scored_twos = scored_twos.select("lang", "w1", "w2", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", cut("f1", "f2").alias("best"))
    third = ones.select("lang", F.col("x1").alias("w3"), F.col("fx").alias("f3"))
    before = pair.select("lang", F.col("p1").alias("w1"), F.col("p2").alias("w2"), F.col("fp").alias("f12"))
    after = pair.select("lang", F.col("p1").alias("w2"), F.col("p2").alias("w3"), F.col("fp").alias("f23"))
    scored = threes.join(before, ["lang", "w1", "w2"]).join(after, ["lang", "w2", "w3"]).join(head, ["lang", "w1"]).join(third, ["lang", "w3"])
    first, last = cut("f1", "f23"), cut("f12", "f3")
    best = F.when(first["score"] <= last["score"], first).otherwise(last)
    scored_threes = scored.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", best.alias("best"))
    # The most frequent longer candidate around each pair of words.
    around = threes.select("lang", "w1", "w2", "a").union(threes.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
    around = around.groupBy("lang", "w1", "w2").agg(F.max("a").alias("longer"))
    own = scored_twos.join(around, ["lang", "w1", "w2"], "left").filter(
        F.col("longer").isNull() | (100 * F.col("longer") < COVERED * F.col("a"))
    )
    every = own.select("lang", "phrase", "a", "best").union(scored_threes).select("lang", "phrase", "a", "best.*")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The first of all are among the first of each lot, so no task orders a whole language.
    lot = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    short = every.withColumn("rank", F.row_number().over(lot)).filter(F.col("rank") <= top)
    ranked = short.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, rowid AS row,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) AS piece
  FROM (SELECT *, row_number() OVER () AS rowid FROM documents)),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, size, array_to_string(w[k : k + size - 1], ' ') AS phrase
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM worded, (VALUES (1), (2), (3)) s(size))),
f AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM f WHERE size = 1 GROUP BY lang),
candidates AS (SELECT lang, size, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE size > 1 AND f >= 10),
cuts AS (
  SELECT c.*, k, array_to_string(w[1 : k], ' ') AS head, array_to_string(w[k + 1 : size], ' ') AS tail
  FROM candidates c, (VALUES (1), (2)) t(k) WHERE k < size),
scored AS (
  SELECT c.lang, c.size, c.phrase, a, k, h.f AS l, t.f AS r,
         1000000 * a::HUGEINT * a::HUGEINT // (h.f::HUGEINT * t.f::HUGEINT) AS score
  FROM cuts c JOIN f h ON h.lang = c.lang AND h.size = k AND h.phrase = head
       JOIN f t ON t.lang = c.lang AND t.size = c.size - k AND t.phrase = tail),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase, size ORDER BY score, k) = 1),
around AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM candidates WHERE size = 3
    UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM candidates WHERE size = 3) GROUP BY lang, phrase),
kept AS (
  SELECT b.* FROM best b LEFT JOIN around o ON o.lang = b.lang AND o.phrase = b.phrase AND b.size = 2
  WHERE o.longer IS NULL OR 100 * o.longer < 50 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
