"""Rounding and time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column, places: int = 2) -> Column:
    """For values that are not negative."""
    scale = float(10**places)
    return F.floor(x * scale + 0.5) / scale


def status_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def epoch_millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))
