"""Interval arithmetic and labels."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds from 1 January of year 1 to the Unix epoch; intervals are counted from there.
YEAR_ONE = 62135596800


def truncate(timestamp: Column, seconds: Column) -> Column:
    """The start of the interval that holds a timestamp."""
    whole = F.floor(F.unix_micros(timestamp) / 1_000_000)
    return F.timestamp_seconds(whole - F.pmod(whole + YEAR_ONE, seconds))


def window_start(interval: timedelta) -> str:
    """startTime for Spark's window() that gives the same buckets as truncate."""
    seconds = int(interval.total_seconds())
    return f"{-YEAR_ONE % seconds} seconds"


def interval_label(seconds: int) -> str:
    """60m, 10m, 1s: whole minutes (rounded half to even) from one minute on, else seconds."""
    return f"{seconds / 60:.0f}m" if seconds >= 60 else f"{seconds:.0f}s"


def label_column(seconds: Column, intervals: list[int]) -> Column:
    out = F.lit(None).cast("string")
    for s in intervals:
        out = F.when(seconds == s, F.lit(interval_label(s))).otherwise(out)
    return out
