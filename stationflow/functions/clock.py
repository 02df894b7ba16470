"""Time columns.

Times are compared as microseconds since 1970 in UTC. A ``timestamp_ntz`` column is read as UTC wall
clock, a ``timestamp`` column as an instant, so no result depends on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECOND_US = 1_000_000
MINUTE_US = 60 * SECOND_US
HOUR_US = 60 * MINUTE_US
DAY_US = 24 * HOUR_US


def _epoch() -> Column:
    return F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")


def epoch_us(df: DataFrame, name: str) -> Column:
    if dict(df.dtypes)[name] == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", _epoch(), F.col(name))
    return F.unix_micros(F.col(name))


def time_like(df: DataFrame, name: str, us: Column) -> Column:
    """Microseconds as a column of the same time type as ``df[name]``."""
    if dict(df.dtypes)[name] == "timestamp_ntz":
        return utc_wall(us)
    return F.timestamp_micros(us)


def utc_wall(us: Column) -> Column:
    return F.timestamp_add("MICROSECOND", us, _epoch())


def local_wall(us: Column, tz: str) -> Column:
    """Wall clock in ``tz``; daylight saving is applied, so a repeated hour keeps one label."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), utc_wall(us))


def floor_div(value: Column, divisor) -> Column:
    """Whole-number division rounding down, exact for bigint."""
    divisor = F.lit(divisor) if isinstance(divisor, int) else divisor
    return F.call_function("div", value - F.pmod(value, divisor), divisor)


def minutes_between(start_us: Column, end_us: Column) -> Column:
    """Minute boundaries crossed from start to end."""
    return floor_div(end_us, MINUTE_US) - floor_div(start_us, MINUTE_US)


def seconds_between(start_us: Column, end_us: Column) -> Column:
    """Second boundaries crossed from start to end."""
    return floor_div(end_us, SECOND_US) - floor_div(start_us, SECOND_US)


def hour_label(us: Column, tz: str) -> Column:
    hour = F.hour(local_wall(us, tz)).cast("string")
    return F.concat(F.lpad(hour, 2, "0"), F.lit(":00"))


def minute_label(us: Column, tz: str) -> Column:
    wall = local_wall(us, tz)
    hour = F.lpad(F.hour(wall).cast("string"), 2, "0")
    return F.concat(hour, F.lit(":"), F.lpad(F.minute(wall).cast("string"), 2, "0"))


def month_label(us: Column, tz: str) -> Column:
    wall = local_wall(us, tz)
    return F.concat(F.year(wall).cast("string"), F.lit("-"), F.lpad(F.month(wall).cast("string"), 2, "0"))


def weekday(wall: Column) -> Column:
    """0 is Sunday."""
    return F.dayofweek(wall) - 1
