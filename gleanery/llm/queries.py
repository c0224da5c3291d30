"""The corpus operators over the given tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleanery.llm import bpe, classifier, collocations, decontaminate, exact_dedup, line_dedup, merkle, mixing, near_dedup, rules, sharding, substrings, warc
from gleanery.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_quality_rules", rules.ORACLE_SQL)
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"))


@query("op2_quality_classifier")
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classifier.score(docs, classifier.fit(docs))


@query("op3_minhash_near_dedup")
def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_copies(table(spark, sf_dir, "documents"), width=4, percent=80)


@query(
    "op4_mixing",
    r"""
    WITH counts AS (SELECT source, count(*) AS n, sqrt(count(*)) AS w FROM documents GROUP BY source),
    rates AS (SELECT source, w / sum(w) OVER () * sum(n) OVER () / n AS rate FROM counts),
    terms AS (
      SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf
      FROM (SELECT source, rate, unnest(range(0, (ceil(rate + 12 * sqrt(rate)) + 31)::BIGINT)) AS k FROM rates)),
    drawn AS (
      SELECT d.*, ('0x' || substr(md5('0|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0 AS u
      FROM documents d),
    counted AS (
      SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars,
             (SELECT count(*) FROM terms t WHERE t.source IS NOT DISTINCT FROM d.source AND t.cdf <= d.u)::INT AS n_copies
      FROM drawn d),
    copies AS (SELECT *, unnest(range(1, n_copies + 1))::INT AS copy_no FROM counted WHERE n_copies > 0)
    SELECT *, ('0x' || substr(md5('0|place|' || coalesce(doc_id::VARCHAR, 'null') || '|' || copy_no), 1, 13))::BIGINT AS position
    FROM copies
    """,
)
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op5_byte_bpe")
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )


@query("op6_sharding")
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


@query(
    "op7_warc",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS hex FROM pages),
    k AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS keeper FROM p)
    SELECT page_id, strlen(h) AS payload_bytes,
           array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
             ((('0x' || substr(hex, ((i // 4) * 5 + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '') AS payload_digest,
           CASE WHEN keeper IS NULL OR keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN keeper <> page_id THEN keeper END AS refers_to
    FROM k
    """,
)
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


@query("op8_fuzzy_lines")
def op8_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.similar_lines(table(spark, sf_dir, "documents"))


@query("op9_repeated_substrings")
def op9_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.drop_repeats(table(spark, sf_dir, "documents"))


@query(
    "op10_exact_dedup",
    r"""
    WITH n AS (
      SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
    SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id = min(doc_id) OVER g AS kept, text_sha256
    FROM n WINDOW g AS (PARTITION BY text_sha256)
    """,
)
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_copies(table(spark, sf_dir, "documents"))


@query("op11_decontamination", decontaminate.ORACLE_SQL)
def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("spans", "items")


@query("op12_merkle_manifest", merkle.ORACLE_SQL)
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    return merkle.manifest(table(spark, sf_dir, "documents"), merkle.fifth(), columns)


@query("op13_collocations", collocations.ORACLE_SQL)
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))
