"""Exact de-duplication by content-defined chunk recipes.

A text, white space normalised, is cut into chunks where its content says so. Equal
chunks get one identifier; identifiers are verified against the chunks' characters,
because a 64-bit fingerprint alone may collide. A text is then the ordered list of
its identifiers, and texts are equal when the lists are: a few longs per text are
grouped and joined, and the texts themselves are moved once, by chunk.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import SPACE, fresh, last, required, whole
from gleanery.session import stored

#: A chunk ends after the first sentence end at or beyond this many characters ...
LEAST_CHUNK = 512
#: ... or here, when there is none.
MOST_CHUNK = 4096


def chunks_of(body: Column) -> Column:
    """Content-defined chunks, in order; their concatenation is ``body``."""
    cut = rf"(?s).{{{LEAST_CHUNK},{MOST_CHUNK - 1}}}?(?<=[.!?] )|.{{1,{MOST_CHUNK}}}"
    return F.regexp_extract_all(body, F.lit(cut), F.lit(0))


def mark_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fingerprint: Callable[[Column], Column] = F.xxhash64
) -> DataFrame:
    """One row per row of ``docs``: (id, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical after each run of ASCII white space became one
    space. Null counts as the empty text. The smallest id of equal texts stays; a
    null id comes after every other. Of repeated rows (same id, equal text) one is
    kept. Other columns of ``docs`` are ignored. An empty table gives no rows.
    """
    required(docs, id_col, text_col)
    body = docs.select(
        F.col(id_col).alias("doc_id"), F.regexp_replace(whole(text_col), SPACE, " ").alias("body")
    )
    lists = stored(
        body.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            F.sha2("body", 256).alias("text_sha256"),
            F.transform(chunks_of(F.col("body")), lambda c: fingerprint(c)).alias("marks"),
        ),
        "recipes",
    )
    pieces = body.select("doc_id", "body", F.posexplode(chunks_of(F.col("body"))).alias("at", "chunk")).withColumn(
        "mark", fingerprint(F.col("chunk"))
    )
    # Every distinct chunk, compared by its characters; a mark with two of them is no identifier.
    contents = pieces.groupBy("mark", "chunk").agg(F.lit(1).alias("one"))
    shared = stored(contents.groupBy("mark").count().filter("count > 1").select("mark"), "shared_marks")
    recipe = ["marks"]
    if not shared.isEmpty():
        lists, recipe = _resolved(lists, pieces, contents, shared), ["marks", "others"]
    groups = stored(
        lists.groupBy(*recipe)
        .agg(F.min(F.struct(last(F.col("doc_id")).alias("id"), "row")).alias("first"), F.count("*").alias("group_size"))
        .filter("group_size > 1"),
        "equal_recipes",
    )
    found = lists.join(groups, recipe, "left")
    alone = F.col("first").isNull()
    return found.select(
        F.col("doc_id").alias(id_col),
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.id.value")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("first.row"))).alias("kept"),
        "text_sha256",
    )


def _resolved(lists: DataFrame, pieces: DataFrame, contents: DataFrame, shared: DataFrame) -> DataFrame:
    """Add, for marks that several chunks share, which of them stands at each place.

    The number of a chunk among those with its mark is fixed by its characters. Such
    marks come from collisions, so this joins few rows.
    """
    numbered = contents.join(shared, "mark", "left_semi").groupBy("mark").agg(F.array_sort(F.collect_list("chunk")).alias("all"))
    numbered = numbered.select("mark", F.posexplode("all").alias("number", "chunk"))
    places = (
        pieces.withColumn("text_sha256", F.sha2("body", 256))
        .join(numbered, ["mark", "chunk"])
        .select("doc_id", "text_sha256", "at", "number")
        .distinct()
        .groupBy("doc_id", "text_sha256")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "number"))), lambda s: s["number"]).alias("others"))
        .withColumnsRenamed({"doc_id": "d", "text_sha256": "s"})
    )
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_sha256") == F.col("s"))
    none = F.array().cast("array<int>")
    return stored(
        lists.join(places, same, "left").drop("d", "s").withColumn("others", F.coalesce("others", none)), "resolved"
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    marks = stored(mark_copies(docs, id_col, text_col), "copy_marks")
    mine = fresh(docs, "kept_id")
    kept = marks.filter("kept").select(F.col(id_col).alias(mine))
    same = F.col(id_col).eqNullSafe(F.col(mine))
    # Rows repeated under one id, all of the same text or not, need counting and not only looking up.
    counts = marks.groupBy(F.col(id_col).alias(mine)).agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("k"))
    repeated = stored(counts.filter("n > 1 and k > 0").select(mine), "repeated_ids")
    many = repeated.select(F.col(mine).alias(f"{mine}_many"))
    once = kept.join(many, F.col(mine).eqNullSafe(F.col(f"{mine}_many")), "left_anti")
    plain = docs.join(once, same, "left_semi")
    if repeated.isEmpty():
        return plain
    sha, wanted_sha = fresh(docs, "body_sha"), fresh(docs, "wanted_sha")
    wanted = marks.filter("kept").select(F.col(id_col).alias(mine), F.col("text_sha256").alias(wanted_sha))
    again = docs.join(repeated, same, "left_semi").withColumn(sha, F.sha2(F.regexp_replace(whole(text_col), SPACE, " "), 256))
    again = again.join(wanted, same & (F.col(sha) == F.col(wanted_sha)), "left_semi").dropDuplicates([id_col, sha])
    return plain.unionByName(again.drop(sha))
