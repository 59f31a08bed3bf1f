"""Timestamp parsing and day arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from basketry.functions.text import strip_ws


def parse_utc_timestamp(c: Column) -> Column:
    """ISO-8601 with 'Z', an offset, or naive (taken as UTC); bad -> null.
    A whole date is required: Spark alone would read a bare time as today.

    ``try_to_timestamp`` never raises under ANSI mode, unlike ``to_timestamp``.
    The session zone is UTC, so naive strings are UTC instants.
    """
    text = strip_ws(c.cast("string"))
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), F.try_to_timestamp(text))


def whole_days(start: Column, end: Column) -> Column:
    """Number of whole 24-hour periods from start to end (Python ``.days``)."""
    seconds = F.unix_timestamp(end) - F.unix_timestamp(start)
    return F.floor(seconds / F.lit(86400)).cast("bigint")


def iso_utc(ts: Column) -> Column:
    """ISO-8601 text with 'Z', fraction only when non-zero (Python isoformat)."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    frac = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return F.when(ts.isNull(), F.lit(None).cast("string")) \
            .when(F.unix_micros(ts) % 1000000 == 0, whole).otherwise(frac)
