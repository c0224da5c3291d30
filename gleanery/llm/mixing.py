"""Mixing sources to target weights by Poisson replication.

Each document is repeated as often as a Poisson variable with its source's mean
repetition rate says. The variable comes from a hash of the seed and the document,
by inverting the distribution, so any executor computes the same count again.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import fresh, required, without
from gleanery.session import stored

#: Default target weight of a source: its number of documents to this power.
EVENNESS = 0.5
#: Hash bits used for a uniform number; a double holds them exactly.
BITS = 52

# How far Stirling's formula for the logarithm of k! is off, for the k that its series does not serve.
_STIRLING = [0.0, *(math.lgamma(k + 1) - (k + 0.5) * math.log(k) + k - 0.5 * math.log(2 * math.pi) for k in range(1, 16))]


def hash52(*parts: Column | str) -> Column:
    """52 bits of the MD5 of the parts joined by '|', as a long; null reads as 'null'."""
    text = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("null")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *text)), 1, 13), 16, 10).cast("long")


def poisson_p(rate: Column, k: Column) -> Column:
    """P(X = k) of a Poisson variable, 0 for every k > 0 at rate 0.

    In saddle-point form: ``exp(-rate)`` and the powers and factorials, which leave a double's
    range, cancel before they are computed. No term needs another one.
    """
    x = F.greatest(k, F.lit(1)).cast("double")
    series = 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    small = F.array(*[F.lit(e) for e in _STIRLING])
    beyond = F.when(k < len(_STIRLING), F.get(small, k.cast("int"))).otherwise(series)
    away = (rate - x) / x
    p = F.exp(x * (F.log1p(away) - away) - beyond) / F.sqrt(F.lit(2 * math.pi) * x)
    return F.when(k == 0, F.exp(-rate)).otherwise(F.coalesce(p, F.lit(0.0)))


def poisson_cdf(rates: DataFrame, key: str, rate: str) -> DataFrame:
    """(key, first, cdf) per row of ``rates``, whose keys differ: P(X <= k) for k = first, first + 1, ...

    The table holds 12 standard deviations and 30 numbers on either side of the rate. What lies outside is less
    than a double tells from 0 or 1. So its length is about 24 times the root of the rate: less than the copies that
    any one document of that rate gets, once the rate is large.
    """
    mean = F.col(rate)
    reach = F.lit(12.0) * F.sqrt(mean) + F.lit(30.0)
    low = F.greatest(F.floor(mean - reach), F.lit(0)).cast("long")
    terms = rates.select(key, rate, F.explode(F.sequence(low, F.ceil(mean + reach).cast("long"))).alias("k"))
    reached = F.sum("p").over(Window.partitionBy(key).orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    summed = terms.withColumn("p", poisson_p(mean, F.col("k"))).withColumn("reached", reached)
    # Sums of what is not negative never fall, so their order is that of k.
    return summed.groupBy(key).agg(F.min("k").alias("first"), F.array_sort(F.collect_list("reached")).alias("cdf"))


def source_rates(
    docs: DataFrame, weights: Mapping[str | None, float] | None = None, total: int | None = None, source_col: str = "source"
) -> DataFrame:
    """(source, n_docs, target_share, rate) per source; one scan of one column.

    ``weights`` are target weights, normalised over the sources present; a source it
    does not name gets none. By default they are ``n_docs ** EVENNESS``. ``total`` is
    the expected number of rows of the mix, by default that of the input. Documents
    without a source are a source of their own.
    """
    if weights is not None and any(w < 0 for w in weights.values()):
        raise ValueError("weights must not be negative")
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n_docs"))
    if weights is None:
        weight = F.pow(F.col("n_docs").cast("double"), F.lit(EVENNESS))
    else:
        weight = F.lit(0.0)
        for name, value in weights.items():
            here = F.col("source").isNull() if name is None else F.col("source") == F.lit(name)
            weight = F.when(here, F.lit(float(value))).otherwise(weight)
    weighed = stored(counts.withColumn("weight", weight), "source_weights")
    sums = weighed.agg(F.sum("weight").alias("w"), F.sum("n_docs").alias("n")).first()
    if sums["n"] is not None and not sums["w"]:
        raise ValueError("no source present has a weight")
    share = F.col("weight") / F.lit(float(sums["w"] or 1))
    rate = share * F.lit(float(sums["n"] or 0) if total is None else float(total)) / F.col("n_docs")
    return weighed.select("source", "n_docs", share.alias("target_share"), rate.alias("rate"))


def mix(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    total: int | None = None,
    seed: int = 0,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """Each document as many times as drawn, globally shuffled.

    Adds ``copy_no`` (1..n_copies), ``n_copies`` and ``position``; rows are dealt to
    partitions and ordered inside them by ``position``, a hash, so ordering the result
    by it is one reproducible shuffle of the whole. Rows with the same id, null
    included, draw the same count. Text and further columns are carried as they are,
    but columns of the three added names are replaced. An empty table gives no rows.
    """
    required(docs, id_col, source_col)
    docs = without(docs, "copy_no", "n_copies", "position")
    mine, first, cdf, u = (fresh(docs, n) for n in ("mix_source", "mix_first", "mix_cdf", "mix_u"))
    # One row per source, with a measured size: Spark broadcasts it only below its threshold.
    tables = poisson_cdf(source_rates(docs, weights, total, source_col), "source", "rate")
    tables = stored(tables.select(F.col("source").alias(mine), F.col("first").alias(first), F.col("cdf").alias(cdf)), "source_rates")
    drawn = docs.withColumn(u, hash52(F.lit(seed), F.col(id_col)) / F.lit(float(1 << BITS)))
    below = F.size(F.filter(F.col(cdf), lambda c: c <= F.col(u)))
    counted = drawn.join(tables, F.col(source_col).eqNullSafe(F.col(mine))).withColumn("n_copies", (F.col(first) + below).cast("int"))
    copies = counted.filter("n_copies > 0").select(
        *docs.columns, F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy_no"), "n_copies"
    )
    placed = copies.withColumn("position", hash52(F.lit(seed), F.lit("place"), F.col(id_col), F.col("copy_no")))
    return placed.repartition("position").sortWithinPartitions("position")
