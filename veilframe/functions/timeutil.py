"""Session-time-zone independent conversions of wall-clock timestamps.

Fixture timestamps are ``timestamp_ntz`` wall clocks in UTC.  Casting them to
``timestamp`` would read them in the session time zone; these helpers read
them as UTC whatever the session says.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_micros(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def epoch_millis(ts: Column) -> Column:
    """Integer epoch milliseconds, floored by exact integer arithmetic (a
    double quotient could round ...999 up)."""
    us = epoch_micros(ts)
    return ((us - F.pmod(us, F.lit(1000))) / 1000).cast("long")


def utc_instant(ts: Column) -> Column:
    """The wall clock as a ``timestamp`` instant (for watermarks and windows)."""
    return F.timestamp_micros(epoch_micros(ts))
