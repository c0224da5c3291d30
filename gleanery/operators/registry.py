"""Named extractors, metrics and rule sets."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators import metrics
from gleanery.operators.validation import Rule, validate


class Registry:
    """A checked name -> value table: no blank, malformed or repeated name."""

    def __init__(self, what: str) -> None:
        self.what = what
        self._entries: dict[str, object] = {}

    def add(self, name: str, value: object) -> None:
        if not isinstance(name, str) or not re.fullmatch(r"[A-Za-z][A-Za-z0-9_]*", name):
            raise ValueError(f"{self.what} name must be letters, digits and underscores: {name!r}")
        if name in self._entries:
            raise ValueError(f"{self.what} already registered: {name}")
        self._entries[name] = value

    def get(self, name: str):
        if name not in self._entries:
            raise KeyError(f"unknown {self.what}: {name} (known: {', '.join(sorted(self._entries)) or 'none'})")
        return self._entries[name]

    def names(self) -> list[str]:
        return sorted(self._entries)


extractors = Registry("extractor")
metric_kinds = Registry("metric")
rule_sets = Registry("rule set")


def register_extractor(name: str, extractor: Callable[[DataFrame], DataFrame]) -> None:
    """An extractor turns pages into rows."""
    if not callable(extractor):
        raise TypeError("an extractor must be a function of a DataFrame")
    extractors.add(name, extractor)


def run_extractor(name: str, pages: DataFrame) -> DataFrame:
    return extractors.get(name)(pages)


def register_table_function(spark: SparkSession, name: str, handler: type, returns: str) -> None:
    """Offer a handler class to SQL as a table function over a table: ``name(TABLE(SELECT ...))``.

    Its ``eval`` gets Arrow batches of the table's rows and yields Arrow tables.
    """
    spark.udtf.register(name, F.arrow_udtf(handler, returnType=returns))


def register_metric(name: str, kind: str, labels: Sequence[str] = (), buckets: Sequence[float] = ()) -> None:
    """A counter sums, a gauge keeps its last value, a histogram counts into buckets."""
    if kind not in ("counter", "gauge", "histogram"):
        raise ValueError("metric kind must be counter, gauge or histogram")
    if kind == "histogram" and not buckets:
        raise ValueError("a histogram needs bucket bounds")
    metric_kinds.add(name, (kind, tuple(labels), tuple(buckets)))


def collect_metric(name: str, samples: DataFrame, value: str = "value", ts: str = "ts", tie: str = "sample_id") -> DataFrame:
    """Aggregate samples into the named metric, by its labels."""
    kind, labels, buckets = metric_kinds.get(name)
    if kind == "histogram":
        return metrics.duration_histogram(samples, value, buckets, labels)
    builders: dict[str, Column] = {"counter": F.sum(value), "gauge": F.max_by(value, F.struct(ts, tie))}
    return samples.groupBy(*labels).agg(builders[kind].alias("value"))


def register_rules(name: str, rules: Callable[[], Sequence[Rule]]) -> None:
    """Rules are built when used, because Columns need a session."""
    rule_sets.add(name, rules)


def validate_as(name: str, df: DataFrame) -> DataFrame:
    return validate(df, rule_sets.get(name)())
