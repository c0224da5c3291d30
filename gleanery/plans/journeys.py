"""End-to-end jobs: crawled text, recognised documents, stored data, metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions.text import clean_text, noise_ratio
from gleanery.functions.values import epoch_seconds
from gleanery.operators import alerts, extract, monitoring, recognition, validation
from gleanery.operators.validation import Rule


def text_rules(text: str = "text", max_len: int = 10_000, max_noise: float = 0.1) -> list[Rule]:
    """Rules for one text field: present, not over-long, not mostly noise."""
    column = F.col(text)
    return [
        ("content_empty", F.coalesce(F.trim(column) == "", F.lit(True))),
        ("content_too_long", F.length(column) > max_len),
        ("content_noisy", noise_ratio(column) > max_noise),
    ]


def clean_by_source(documents: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """Per source: documents kept after validation, cleaning and de-duplication, and rejects.

    De-duplication is on the cleaned text within the source; the two levels of
    aggregation keep one row per text on the map side.
    """
    checked = documents.select("source", "text", validation.errors_of(rules or text_rules()).alias("errors"))
    rejected = F.size("errors") > 0
    # Rejected rows are counted only; their text is not cleaned or shuffled.
    cleaned = clean_text(F.when(~rejected, F.col("text")))
    rows = checked.select("source", rejected.alias("rejected"), cleaned.alias("clean"))
    per_text = rows.groupBy(
        "source", "rejected", F.when(~F.col("rejected"), F.sha2("clean", 256)).alias("fingerprint")
    ).agg(F.count("*").alias("copies"), F.max(F.length("clean")).alias("chars"))
    kept = ~F.col("rejected")
    return per_text.groupBy("source").agg(
        F.count_if(kept).alias("documents"),
        F.coalesce(F.sum(F.when(kept, F.col("copies") - 1)), F.lit(0)).alias("duplicates"),
        F.round(F.avg(F.when(kept, F.col("chars"))), 6).alias("mean_chars"),
        F.coalesce(F.sum(F.when(~kept, F.col("copies"))), F.lit(0)).alias("rejected"),
    )


def scrape_text(pages: DataFrame, selectors: Mapping[str, str], rules: Sequence[Rule] | None = None) -> tuple[DataFrame, DataFrame]:
    """Pages -> selected texts, validated: (accepted, quarantine)."""
    found = extract.extract_selectors(pages, selectors)
    return validation.split_valid(found, rules or text_rules("value", max_noise=1.0))


def recognise(words: DataFrame, fmt: str = "json", minimum: float = 0.85) -> DataFrame:
    """Words -> documents that pass the quality check, in the output format."""
    documents = recognition.assemble_text(words)
    # Judged on the whole document: all of its parts pass or none does.
    good = (F.col("confidence") >= minimum) & ~F.col("blank") & (F.col("noise") <= 0.1)
    return recognition.format_ocr(documents.filter(good), fmt)


def latency_alerts(requests: DataFrame, by: Sequence[str], seconds: str, ts: str = "ts", rule: monitoring.AlertRule = monitoring.HIGH_LATENCY) -> DataFrame:
    """Request log -> p95 of five minutes at each tick -> alerts that fire -> inhibited and routed."""
    fired = monitoring.firing(monitoring.latency_p95(requests, by, ts, seconds), by, rule)
    return alerts.route_alerts(alerts.inhibit(fired))
