"""Time scalars; the current time is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STALLED_S, WARNING_S = 60, 30


def at(now: str) -> Column:
    return F.lit(now).cast("timestamp_ntz")


def seconds_since(ts: Column, now: Column) -> Column:
    """Whole seconds from ``ts`` to ``now``, rounded down, so a moment after ``now`` is at least a second off."""
    return F.floor(F.timestamp_diff("MICROSECOND", ts, now) / 1_000_000)


def relative_label(ts: Column, now: Column) -> Column:
    """Today, Yesterday, days, weeks, or the date, by periods of 24 hours."""
    days = F.floor(seconds_since(ts, now) / 86400)
    weeks = F.floor(days / 7)
    return (
        F.when(ts.isNull(), None)
        .when(days == 0, "Today")
        .when(days == 1, "Yesterday")
        .when(days < 7, F.concat(days.cast("string"), F.lit(" days ago")))
        .when(days < 30, F.concat(weeks.cast("string"), F.when(weeks > 1, " weeks ago").otherwise(" week ago")))
        .otherwise(F.date_format(ts, "MM/dd/yyyy"))
    )


def percent(done: Column, total: Column) -> Column:
    """Progress in whole percent, rounded half to even, at most 100; 0 without a total."""
    return F.when(F.coalesce(total, F.lit(0)) <= 0, 0).otherwise(F.least(F.lit(100), F.bround(F.coalesce(done, F.lit(0)) * 100.0 / total, 0).cast("int")))


def health_at(age: Column) -> Column:
    return F.when(age > STALLED_S, "stalled").when(age > WARNING_S, "warning").otherwise("healthy")


def health(heartbeat: Column, now: Column) -> Column:
    return F.when(heartbeat.isNull(), "unknown").otherwise(health_at(seconds_since(heartbeat, now)))


def pages(total: Column, limit: int) -> Column:
    return F.ceil(total / limit).cast("long")
