"""A Merkle manifest of a dataset, with a witness for every row.

Rows are leaves; those of a source, in order of id, are the leaves of its tree, and the
roots of the sources are the leaves of the tree above. Trees are built by appending: a
task appends the nodes of one aligned block, ``ARITY ** LEVELS`` of them at most, one after
the other. A node that is appended takes its left siblings as a first part of its witness
and leaves itself to theirs; a run that is full becomes an append to the level above. What
a whole subtree shares of a witness is kept once, with that subtree's root.

The roots of the blocks are a table again, and further appends: its blocks are appended
in the same way until one node is left. Then the witnesses go down again, block by block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import required
from gleanery.session import stored

#: Children of a node, and levels of a block: 4,096 nodes are appended in one place.
ARITY = 16
LEVELS = 3


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class _Open:
    """A subtree that has got no parent yet, and the witness its leaves share so far."""

    __slots__ = ("node", "parent", "place", "siblings")

    def __init__(self, node: str) -> None:
        self.node, self.parent, self.place = node, None, 0
        self.siblings: list[str] = []


class Appender:
    """A tree of at most ``levels`` levels that grows by one node at a time."""

    def __init__(self, levels: int) -> None:
        self.runs: list[list[_Open]] = [[] for _ in range(levels + 1)]

    def append(self, node: str) -> _Open:
        return self._put(0, node)

    def _put(self, level: int, node: str) -> _Open:
        subtree, run = _Open(node), self.runs[level]
        subtree.place = len(run)
        subtree.siblings = [s.node for s in run]
        for earlier in run:
            earlier.siblings.append(node)
        run.append(subtree)
        if len(run) == ARITY and level + 1 < len(self.runs):
            self._close(level)
        return subtree

    def _close(self, level: int) -> None:
        run, self.runs[level] = self.runs[level], []
        above = self._put(level + 1, digest(*(s.node for s in run)))
        for subtree in run:
            subtree.parent = above

    def finish(self) -> str:
        """Close what is open, short runs too; the node at the top."""
        for level in range(len(self.runs) - 1):
            if self.runs[level]:
                self._close(level)
        (top,) = self.runs[-1]
        return top.node


def witness(leaf: _Open) -> Iterator[tuple[int, list[str]]]:
    """Per level the leaf's place in its run and its siblings, up to the tree's top."""
    while leaf.parent is not None:
        yield leaf.place, leaf.siblings
        leaf = leaf.parent


def fold(leaf: str, path: list[tuple[int, list[str]]]) -> str:
    """The root that a leaf and its witness give."""
    return reduce(lambda node, step: digest(*step[1][: step[0]], node, *step[1][step[0] :]), path, leaf)


def _field(name: str) -> Column:
    value = F.col(name).cast("string")
    return F.coalesce(F.concat(F.octet_length(value), F.lit(":"), value), F.lit("-"))


def leaf_of(columns: list[str], replaced: dict[str, Column] | None = None) -> Column:
    """The digest of a row's columns, each with its length in bytes; null differs from empty."""
    values = []
    for c in columns:
        value = (replaced or {}).get(c)
        values.append(_field(c) if value is None else F.coalesce(F.concat(F.octet_length(value), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*values), 256)


def _placed(nodes: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``nodes`` with ``place``, their number from 0 within the group, and its ``size``.

    Range partitions keep a large group in many tasks; only a row per group and partition
    is ordered by itself. The cut comes from a sample, so the partitions are written.
    """
    ranged = nodes.repartitionByRange(*group, *order).withColumn("part", F.spark_partition_id())
    ranged = stored(ranged, name)
    per_part = ranged.groupBy(*group, "part").agg(F.count("*").alias("n"))
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per_part = per_part.select(
        *[F.col(g).alias(f"its_{g}") for g in group], F.col("part").alias("its_part"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("size"),
    )
    same = reduce(lambda a, g: a & F.col(g).eqNullSafe(F.col(f"its_{g}")), group, F.col("part") == F.col("its_part"))
    inside = F.row_number().over(Window.partitionBy(*group, "part").orderBy(*order)) - 1
    found = ranged.withColumn("inside", inside).join(per_part, same)
    return found.withColumn("place", F.col("before") + F.col("inside")).drop("part", "its_part", "before", "inside", *[f"its_{g}" for g in group])


def _depth(size: int, levels: int) -> int:
    """Levels of a block: all of them where other blocks follow or precede, else what its tree needs."""
    if size > ARITY**levels:
        return levels
    depth = 0
    while size > 1:
        size, depth = -(-size // ARITY), depth + 1
    return depth


def _appended(places: list[int], nodes: list[str], size: int, levels: int) -> tuple[list[_Open], str]:
    by_place = sorted(range(len(places)), key=places.__getitem__)
    tree, leaves = Appender(_depth(size, levels)), [None] * len(places)
    for k in by_place:
        leaves[k] = tree.append(nodes[k])
    return leaves, tree.finish()


def _roots(nodes: DataFrame, levels: int) -> DataFrame:
    """(tree, place, node, size): the root of every block of (tree, place, node, size)."""

    def run(block: pa.Table) -> pa.Table:
        size = block.column("size")[0].as_py()
        _, root = _appended(block.column("place").to_pylist(), block.column("node").to_pylist(), size, levels)
        place = block.column("place")[0].as_py() // ARITY**levels
        return pa.table({
            "tree": block.column("tree").slice(0, 1), "place": pa.array([place], pa.int64()),
            "node": pa.array([root]), "size": pa.array([-(-size // ARITY**levels)], pa.int64()),
        })

    block = F.floor(F.col("place") / ARITY**levels).cast("long").alias("block")
    kinds = "tree long, place long, node string, size long"
    return nodes.select("tree", "place", "node", "size", block).groupBy("tree", "block").applyInArrow(run, kinds)


_STEPS = "array<struct<place:int,siblings:array<string>>>"


def _down(nodes: DataFrame, above: DataFrame | None, emit, kinds: str, levels: int) -> DataFrame:
    """Append every block of ``nodes`` again and hand each node its whole witness.

    ``above`` has the witness (tree, block, steps) of the blocks' roots, none at the top.
    """
    block = F.floor(F.col("place") / ARITY**levels).cast("long")
    nodes = nodes.withColumn("block", block)
    if above is None:
        nodes = nodes.withColumn("steps", F.array().cast(_STEPS))
    else:
        # One copy of the shared steps goes to each block, with its first node.
        first = nodes.filter(F.col("place") % ARITY**levels == 0).join(above, ["tree", "block"]).select(*nodes.columns, "steps")
        rest = nodes.filter(F.col("place") % ARITY**levels != 0).withColumn("steps", F.lit(None).cast(_STEPS))
        nodes = first.unionByName(rest)

    def run(table: pa.Table) -> pa.Table:
        rows = table.drop_columns(["steps"]).to_pylist()
        leaves, _ = _appended(table.column("place").to_pylist(), table.column("node").to_pylist(), rows[0]["size"], levels)
        steps = next(s for s in table.column("steps").drop_null().to_pylist())
        shared = [(s["place"], s["siblings"]) for s in steps]
        return emit(table, rows, [[*witness(leaf), *shared] for leaf in leaves])

    return nodes.groupBy("tree", "block").applyInArrow(run, kinds)


def _hand_on(table: pa.Table, rows: list[dict], paths: list[list]) -> pa.Table:
    steps = [[{"place": p, "siblings": s} for p, s in path] for path in paths]
    kind = pa.list_(pa.struct([("place", pa.int32()), ("siblings", pa.list_(pa.string()))]))
    return pa.table({"tree": table.column("tree"), "block": table.column("place"), "steps": pa.array(steps, kind)})


def _climb(nodes: DataFrame, name: str, levels: int) -> list[DataFrame]:
    """The nodes and, block roots upon block roots, the tables above them up to one node a tree."""
    tables = [nodes]
    while tables[-1].filter(f"size > {ARITY**levels}").limit(1).count():
        tables.append(stored(_roots(tables[-1], levels), f"{name}_blocks"))
    tables.append(stored(_roots(tables[-1], levels), f"{name}_roots"))
    return tables


def manifest(
    docs: DataFrame, tamper: Column, columns: list[str], id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    levels: int = LEVELS,
) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) per row of ``docs``.

    The leaf is the digest of ``columns``. Where ``tamper`` holds, the witness is tried on
    the row with the letters A-Z of its text in lower case; it fails unless there are none.
    A null differs from an empty value; a null source is a source of its own, the first;
    null ids come first. Rows repeated under an id are ordered by their digest, and equal
    rows are leaves of their own. A lone leaf is its source's root, a lone source's root
    the root. An empty table gives no rows; other columns are ignored.
    """
    required(docs, id_col, source_col, text_col, *columns)
    lower = F.translate(F.col(text_col).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tried = F.when(F.coalesce(tamper, F.lit(False)), leaf_of(columns, {text_col: lower}))
    leaves = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), leaf_of(columns).alias("node"), tried.alias("tried")
    )
    placed = stored(_placed(leaves, ["source"], ["id", "node"], "leaves"), "placed_leaves")
    # Sources are numbered in their order; the number stands for the source from here on.
    sources = placed.filter("place = 0").select("source", F.lit(0).alias("all"))
    numbers = stored(_placed(sources, ["all"], ["source"], "sources"), "numbered_sources")
    numbers = numbers.select(F.col("source").alias("s"), F.col("place").alias("tree"), F.col("size").alias("n_sources"))
    docs_of = placed.join(numbers, F.col("source").eqNullSafe(F.col("s"))).drop("s", "source")
    docs_of = stored(docs_of, "leaves_of_trees")
    lower_tables = _climb(docs_of, "source", levels)
    subroots = lower_tables[-1].select("tree", F.col("node").alias("subroot"))
    counted = subroots.join(numbers, "tree")
    upper = counted.select(
        F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.col("subroot").alias("node"), F.col("n_sources").alias("size")
    )
    upper_tables = _climb(stored(upper, "subroots"), "top", levels)
    root = upper_tables[-1].select(F.col("node").alias("root"))

    hand = "tree long, block long, steps " + _STEPS
    above = None
    for table in reversed(upper_tables[:-1]):
        above = stored(_down(table, above, _hand_on, hand, levels), "witnesses_above")
    # The source's number is its place in the tree above; each of its trees ends in one block.
    above = above.select(F.col("block").alias("tree"), F.lit(0).cast("long").alias("block"), "steps")
    for table in reversed(lower_tables[1:-1]):
        above = stored(_down(table, above, _hand_on, hand, levels), "witnesses_of_blocks")
    kind = docs.schema[id_col].dataType.simpleString()

    def emit(table: pa.Table, rows: list[dict], paths: list[list]) -> pa.Table:
        proofs, roots = [], []
        for row, path in zip(rows, paths):
            proofs.append(digest(*(s for _, siblings in path for s in siblings)))
            roots.append(fold(row["node"] if row["tried"] is None else row["tried"], path))
        return pa.table({
            "id": table.column("id"), "leaf": table.column("node"), "tree": table.column("tree"),
            "proof_sha256": pa.array(proofs), "folded_root": pa.array(roots),
        })

    found = _down(docs_of, above, emit, f"id {kind}, leaf string, tree long, proof_sha256 string, folded_root string", levels)
    # A row per source, and one row.
    found = found.join(subroots, "tree").join(F.broadcast(root))
    return found.select(
        F.col("id").alias(id_col), "leaf", "subroot", "root", "proof_sha256", "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def fifth(id_col: str = "doc_id") -> Column:
    """Whether 5 divides the CRC-32 of the id in decimal; unknown for a null id."""
    return F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 5 == 0


ORACLE_SQL = r"""
WITH RECURSIVE fields AS (
  SELECT doc_id, source,
         [doc_id::VARCHAR, source, lang, n_chars::VARCHAR] AS head, text,
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered,
         list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
             lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
           lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))) AS crc
  FROM documents),
texts AS (
  SELECT *, array_to_string(list_transform(head, lambda v: coalesce(strlen(v)::VARCHAR || ':' || v, '-')), '') AS front FROM fields),
leaves AS (
  SELECT doc_id, source, sha256(front || coalesce(strlen(text)::VARCHAR || ':' || text, '-')) AS leaf,
         CASE WHEN xor(crc, 4294967295) % 5 = 0
              THEN sha256(front || coalesce(strlen(lowered)::VARCHAR || ':' || lowered, '-')) END AS tried FROM texts),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
         count(*) OVER (PARTITION BY source) AS n FROM leaves),
tree AS (
  SELECT s, 0 AS level, place, leaf AS h, n FROM placed
  UNION ALL
  SELECT s, level + 1, place // 16, sha256(string_agg(h, '' ORDER BY place)), (n + 15) // 16
  FROM tree WHERE n > 1 GROUP BY s, level, place // 16, n),
runs AS (SELECT s, level, place // 16 AS run, list(h ORDER BY place) AS hs FROM tree WHERE n > 1 GROUP BY s, level, place // 16),
subroots AS (SELECT s, h FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS level, s AS place, h, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, place // 16, sha256(string_agg(h, '' ORDER BY place)), (n + 15) // 16
  FROM top WHERE n > 1 GROUP BY level, place // 16, n),
top_runs AS (SELECT level, place // 16 AS run, list(h ORDER BY place) AS hs FROM top WHERE n > 1 GROUP BY level, place // 16),
climb AS (
  SELECT s, place AS of, 0 AS level, place, coalesce(tried, leaf) AS h, '' AS proof FROM placed
  UNION ALL
  SELECT s, of, level + 1, place // 16,
         sha256(array_to_string(hs[1 : place % 16] || [h] || hs[place % 16 + 2 : 16], '')),
         proof || array_to_string(hs[1 : place % 16] || hs[place % 16 + 2 : 16], '')
  FROM climb JOIN runs USING (s, level) WHERE runs.run = climb.place // 16),
climbed AS (SELECT s, of, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM climb GROUP BY s, of),
climb_top AS (
  SELECT s, of, 0 AS level, s AS place, h, proof FROM climbed
  UNION ALL
  SELECT s, of, level + 1, place // 16,
         sha256(array_to_string(hs[1 : place % 16] || [h] || hs[place % 16 + 2 : 16], '')),
         proof || array_to_string(hs[1 : place % 16] || hs[place % 16 + 2 : 16], '')
  FROM climb_top JOIN top_runs USING (level) WHERE top_runs.run = climb_top.place // 16),
folded AS (SELECT s, of, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM climb_top GROUP BY s, of)
SELECT doc_id, leaf, subroots.h AS subroot, top.h AS root, sha256(folded.proof) AS proof_sha256, folded.h AS folded_root,
       folded.h = top.h AS verified
FROM placed JOIN subroots USING (s) JOIN folded ON folded.s = placed.s AND folded.of = placed.place, top WHERE top.n = 1
"""
