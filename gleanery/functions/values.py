"""Scalar helpers for ids, urls, times and durations."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

UUID_PATTERN = r"^\{?(urn:uuid:)?[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}\}?$"


def moment(value) -> Column:
    """A literal; datetimes without a zone are UTC, whatever the driver's own zone."""
    if not isinstance(value, datetime):
        return F.lit(value)
    return F.timestamp_micros(F.lit(round(utc(value).timestamp() * 1_000_000)))


def utc(value: datetime) -> datetime:
    return value if value.tzinfo else value.replace(tzinfo=timezone.utc)


def stable_id(*parts: Column) -> Column:
    """A repeatable text id: sha256 over the natural key, unlike ``uuid()``."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def is_uuid(value: Column) -> Column:
    return F.coalesce(value.rlike(UUID_PATTERN), F.lit(False))


def parse_iso(value: Column) -> Column:
    """ISO-8601 text (``Z`` or an offset allowed) to timestamp, null when malformed."""
    shaped = value.rlike(
        r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,6})?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?$"
    )
    return F.when(shaped, value.try_cast("timestamp"))


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970, floored."""
    return F.unix_seconds(ts.cast("timestamp"))


def seconds_between(start: Column, end: Column) -> Column:
    """``end - start`` in seconds with the fraction kept."""
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(1e6)


def duration_text(seconds: Column) -> Column:
    """``1d 2h 3m 4s``; zero parts dropped, ``0s`` for nothing."""
    total = seconds.cast("long")
    parts = ((86400, None, "d"), (3600, 24, "h"), (60, 60, "m"), (1, 60, "s"))

    def part(size: int, modulus: int | None, unit: str) -> Column:
        count = F.floor(total / F.lit(size))
        if modulus:
            count = F.pmod(count, F.lit(modulus))
        return F.when(count > 0, F.concat(count.cast("string"), F.lit(unit)))

    text = F.concat_ws(" ", *[part(*p) for p in parts])
    return F.when(total.isNotNull(), F.when(text == "", F.lit("0s")).otherwise(text))


def url_host(url: Column) -> Column:
    """Lower-case host without port; null when the text is no url."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def url_netloc(url: Column) -> Column:
    """Host with user and port, as written."""
    return F.try_parse_url(url, F.lit("AUTHORITY"))


def backoff_seconds(attempt: Column, base: float = 5.0, factor: float = 2.0, ceiling: float | None = None) -> Column:
    """``base * factor ** attempt``, at most ``ceiling``."""
    delay = F.lit(float(base)) * F.pow(F.lit(float(factor)), attempt)
    return delay if ceiling is None else F.least(delay, F.lit(float(ceiling)))


def key_fraction(key: Column) -> Column:
    """A stable number in [0, 1) per key: the first 32 bits of its md5."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") / F.lit(2.0**32)


def as_number(text: Column) -> Column:
    """A decimal number as DOUBLE, null for anything else.

    A cast alone would also read a type suffix, as in ``3D`` or ``5f``.
    """
    plain = F.regexp_like(text.cast("string"), F.lit(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"))
    named = F.lower(F.trim(text.cast("string"))).isin("nan", "inf", "-inf", "+inf", "infinity", "-infinity", "+infinity")
    return F.when(plain | named, text.try_cast("double"))
