"""Timestamps of the many shapes that exports use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Microseconds from 1601 to 1970.
_SINCE_1601 = 11_644_473_600_000_000


def from_epoch(value: Column) -> Column:
    """Seconds, milliseconds (above 1e11) or microseconds (above 1e14) since 1970; null above 1e17 or below 0."""
    n = value.cast("decimal(38,6)")
    micros = F.when(n > 1e14, n).when(n > 1e11, n * 1000).otherwise(n * 1000000)
    return F.when((n >= 0) & (n <= 1e17), F.timestamp_micros(F.floor(micros).cast("long")))


def ts_iso(text: Column) -> Column:
    """A timestamp from text: epochs in digits, ISO dates and times with or without a zone (none is UTC, fractions go),
    mail dates, and dates like '15 Mar 2024'. Null where nothing fits, for 'true' and 'false' too."""
    t = F.trim(text)
    iso = F.regexp_replace(F.regexp_replace(t, r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}(?::\d{2})?)(?:\.\d+)?", "$1T$2"), r"(?<=\d)Z$", "+00:00")
    zoned = F.when(iso.rlike(r"[+-]\d{2}:?\d{2}$"), iso).otherwise(F.concat(iso, F.lit("+00:00")))
    bare = F.concat(t, F.lit("T00:00:00+00:00"))
    mail = F.regexp_replace(F.regexp_replace(t, r"^[A-Za-z]{3},\s*", ""), r"\s*\([^)]*\)$", "")
    mail = F.regexp_replace(F.regexp_replace(mail, r"\s(?:GMT|UTC?)$", " +0000"), r"^(\d) ", "0$1 ")
    when = lambda value, pattern: F.try_to_timestamp(value, F.lit(pattern))
    return (
        F.when(t.rlike(r"^\d+(\.\d+)?$"), from_epoch(t.try_cast("decimal(38,6)")))
        .when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), when(bare, "yyyy-MM-dd'T'HH:mm:ssxxx"))
        .when(iso.rlike(r"^\d{4}-\d{2}-\d{2}T"), F.coalesce(when(zoned, "yyyy-MM-dd'T'HH:mm:ssxxx"), when(zoned, "yyyy-MM-dd'T'HH:mmxxx"), when(zoned, "yyyy-MM-dd'T'HH:mm:ssxx")))
        .otherwise(F.coalesce(when(mail, "dd MMM yyyy HH:mm:ss Z"), when(F.concat(mail, F.lit(" 00:00:00 +0000")), "dd MMM yyyy HH:mm:ss Z")))
    )


def chrome_ts(micros: Column) -> Column:
    """Microseconds since 1601; null at or below 0."""
    n = micros.cast("long")
    return F.when(n > 0, F.timestamp_micros(n - _SINCE_1601))


def month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def recency_weight(ts: Column, as_of_year: int) -> Column:
    """1 from the given year on, 0.5 in the year before, else 0."""
    return F.when(F.year(ts) >= as_of_year, 1.0).when(F.year(ts) >= as_of_year - 1, 0.5).otherwise(0.0)
