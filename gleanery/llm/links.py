"""Links between items that share keys, without all pairs of a group.

Items that share a key are candidates. In a short list of items under one key every pair
is tried. A long list is tried by centres: one item against all others of the list. That
cannot lose a connection, because further centres follow until every item outside the
list's largest component has itself been tried against the whole list; in a list of near
copies the first centre already joins them, and nothing is left to try.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.session import done, stored

#: Lists up to this long are tried pair by pair.
SHORT = 8


def _stars(pairs: DataFrame) -> bool:
    """Whether every node hangs on one other, which hangs on none."""
    twice = pairs.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").select("u")
    inner = pairs.join(pairs.select(F.col("u").alias("v")), "v", "left_semi").select("u")
    return twice.union(inner).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b); the smallest node names it.

    Alternating star operations: each round hangs a node's larger, then its smaller
    neighbours on its smallest one, until only stars are left. The smallest neighbours
    are written before they are joined, so that Spark can split a node with very many
    links over tasks. No links give no rows.
    """
    a, b = F.col("a"), F.col("b")
    pairs = stored(links.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    while not _stars(pairs):
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "lowest")
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "large_star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        inner = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = stored(inner.union(least.select("u", F.col("m").alias("v"))).distinct(), "small_star")
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stored(pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots), "components")


def lists(entries: DataFrame) -> DataFrame:
    """Entries (key, id, rank, own) whose key may give a pair, with ``n`` items and ``centre``.

    Two items are candidates when one of them is the key's ``own``; by default all are.
    The centre is the own item with the smallest ``rank``, by default with the least id.
    """
    if "own" in entries.columns:
        first = F.min(F.when(F.col("own"), F.struct("rank", "id")))["id"]
    else:
        first = F.min("id")
    sizes = entries.groupBy("key").agg(F.count("*").alias("n"), first.alias("centre")).filter("n > 1 AND centre IS NOT NULL")
    near = entries.join(stored(sizes, "list_sizes"), "key")
    return stored(near if "own" in entries.columns else near.withColumns({"rank": F.lit(0), "own": F.lit(True)}), "lists")


def _facts(near: DataFrame) -> list[str]:
    return [c for c in near.columns if c == "facts"]


def candidates(near: DataFrame, short: int = SHORT, fits: str = "true") -> DataFrame:
    """Distinct pairs (a, b), a < b: all of a short list, the centre's of a long one.

    Pairs of short lists are left out at once where ``fits`` does not hold for the ``facts``
    that the entries carry, as ``x.facts`` and ``y.facts``.
    """
    items = F.struct("id", "own", *_facts(near))
    whole = near.filter(F.col("n") <= short).groupBy("key").agg(F.array_sort(F.collect_set(items)).alias("items"))
    first = whole.select("items", F.posexplode("items").alias("at", "x"))
    pairs = first.select("x", F.explode(F.slice("items", F.col("at") + 2, F.lit(short))).alias("y")).filter("x.own OR y.own").filter(fits)
    star = near.filter((F.col("n") > short) & (F.col("id") != F.col("centre")))
    star = star.select(F.least("centre", "id").alias("a"), F.greatest("centre", "id").alias("b"))
    return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).union(star).distinct()


def settle(
    near: DataFrame, links: DataFrame, verify: Callable[[DataFrame], DataFrame], short: int = SHORT, fits: str = "true"
) -> DataFrame:
    """Components of ``links`` and of all further links within the long lists of ``near``.

    ``verify`` keeps the true ones of pairs (a, b), as far as ``fits`` holds for their facts
    (see ``candidates``). Each round takes more centres, so the rounds are few; one that joins
    a list into a single component ends the work on it.
    """
    facts = _facts(near)
    long_lists = stored(near.filter(F.col("n") > short).select("key", "id", "rank", "own", *facts), "long_lists")
    groups, over, lots = components(links), None, 4
    if long_lists.isEmpty():
        return groups
    while True:
        placed = long_lists.join(groups, F.col("id") == F.col("node"), "left")
        placed = stored(placed.select("key", "id", "rank", "own", *facts, F.coalesce("component", "id").alias("group")), "placed")
        sizes = placed.groupBy("key", "group").agg(F.count("*").alias("n"))
        split = sizes.groupBy("key").agg(F.max(F.struct("n", "group")).alias("top"), F.count("*").alias("kinds"))
        split = stored(split.filter("kinds > 1").select("key", F.col("top.group").alias("largest")), "split_lists")
        open_ = placed.join(split, "key")
        untried = open_.filter("`group` != largest")
        if over is not None:
            untried = untried.join(over, ["key", "id"], "left_anti")
        lot = F.pmod(F.xxhash64("id"), F.lit(lots))
        centres = untried.groupBy("key", lot.alias("lot")).agg(F.min(F.struct("rank", "id", "group", "own", *facts)).alias("c"))
        centres = centres.select("key", *[F.col(f"c.{x}").alias(f"centre_{x}") for x in ("id", "group", "own", *facts)])
        centres = stored(centres, "centres")
        if centres.isEmpty():
            return groups
        tried = centres.select("key", F.col("centre_id").alias("id"))
        over = stored(tried if over is None else over.union(tried), "tried")
        apart = (open_["key"] == centres["key"]) & (F.col("group") != F.col("centre_group")) & (F.col("own") | F.col("centre_own"))
        pairs = open_.join(centres, apart & F.expr(fits.replace("x.facts", "facts").replace("y.facts", "centre_facts")))
        pairs = pairs.select(F.least("id", "centre_id").alias("a"), F.greatest("id", "centre_id").alias("b")).distinct()
        more = stored(verify(pairs), "more_links")
        if not more.isEmpty():
            stars = groups.filter("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))
            groups = components(stars.union(more.select("a", "b")))
        done(placed, split, centres, more)
        lots *= 8
