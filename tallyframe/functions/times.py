"""Time keys and partition transforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How far back a named timeframe reaches, in hours.
TIMEFRAMES = {"24h": 24, "7d": 7 * 24, "30d": 30 * 24}


def week_key(ts: Column) -> Column:
    """Year and week, weeks starting on Monday, days before the first Monday in week 00."""
    week = F.floor((F.dayofyear(ts) - 1 + 7 - F.weekday(ts)) / 7)
    return F.concat(F.date_format(ts, "yyyy"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))


def minute_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def hour_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:00")


def day_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def since(ts: Column, now: Column, timeframe: str) -> Column:
    """Whether ``ts`` lies in the timeframe ending at ``now``; ``all`` keeps everything."""
    if timeframe not in TIMEFRAMES:
        return F.lit(True)
    return ts >= now - F.expr(f"INTERVAL {TIMEFRAMES[timeframe]} HOURS")
