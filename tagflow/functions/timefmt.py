"""Timestamp expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ISO-8601 with milliseconds and a "+HH:MM" (or "Z") offset, e.g. 2024-01-02T03:04:05.678+09:00
ISO_MS_OFFSET = "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"
MICROS_PER_HOUR = 3_600_000_000


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def parse_created_lenient(col) -> Column:
    """The fixed format, else Spark's ISO parser, else null; no value is an error."""
    c = _c(col)
    return F.coalesce(F.try_to_timestamp(c, F.lit(ISO_MS_OFFSET)), F.try_to_timestamp(c))


def whole_hours_since(ts, origin) -> Column:
    """Whole hours between origin and ts, plus one (origin itself -> 1)."""
    return F.floor((F.unix_micros(_c(ts)) - F.unix_micros(_c(origin))) / F.lit(MICROS_PER_HOUR)).cast("bigint") + 1


def per_hour(score, hours) -> Column:
    """Score / hours as double; null instead of an ANSI error when hours is 0 (trap 5)."""
    return F.try_divide(_c(score).cast("double"), _c(hours).cast("double"))
