"""Timestamps: epoch milliseconds and their texts. The session's time zone must be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values from here on are milliseconds, below it seconds.
MILLISECONDS_FROM = 100_000_000_000

# Dates as a reader of each locale expects them.
LOCALE_PATTERNS = {"en": "MMM dd, yyyy, hh:mm a", "ja": "yyyy年MM月dd日 HH:mm", "iso": "yyyy-MM-dd HH:mm"}


def epoch_ms(seconds: Column) -> Column:
    """Whole milliseconds of seconds, cut toward zero; null if that is no number."""
    return F.try_multiply(seconds.cast("double"), F.lit(1000.0)).try_cast("bigint")


def millis(ts: Column) -> Column:
    """``ts`` in milliseconds whichever unit it has."""
    return F.when(ts >= MILLISECONDS_FROM, ts).otherwise(ts * 1000)


def iso_utc(ts: Column) -> Column:
    """ISO 8601 in UTC, with microseconds only if there are any; '' of null."""
    at = F.timestamp_millis(millis(ts))
    text = F.when(F.pmod(millis(ts), F.lit(1000)) == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ssxxx")).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"))
    return F.coalesce(text, F.lit(""))


def local_human(ts: Column, tz: str = "UTC", locale: str = "iso") -> Column:
    """Minutes of local time; '' of null."""
    at = F.from_utc_timestamp(F.timestamp_millis(millis(ts)), tz)
    return F.coalesce(F.date_format(at, LOCALE_PATTERNS[locale]), F.lit(""))
