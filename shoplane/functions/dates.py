"""Calendar and duration expressions.

All are Catalyst built-ins and accept DATE, TIMESTAMP or TIMESTAMP_NTZ.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shoplane.functions.text import ColumnOrName, _col

MICROS_PER_DAY = 86_400_000_000


def year(c: ColumnOrName) -> Column:
    return F.year(_col(c))


def month(c: ColumnOrName) -> Column:
    return F.month(_col(c))


def quarter(c: ColumnOrName) -> Column:
    return F.quarter(_col(c))


def iso_week(c: ColumnOrName) -> Column:
    """ISO-8601 week number (2021-01-03 -> 53)."""
    return F.weekofyear(_col(c))


def day_of_week(c: ColumnOrName) -> Column:
    """Monday=0 ... Sunday=6 (not ``dayofweek``, which is Sunday=1)."""
    return F.weekday(_col(c))


def is_weekend(c: ColumnOrName) -> Column:
    """F8: 1 on Saturday/Sunday, else 0 (null date -> null)."""
    return day_of_week(c).isin(5, 6).cast("int")


_UTC_NAMES = {"UTC", "ETC/UTC", "GMT", "ETC/GMT", "Z", "+00:00", "UCT", "ZULU"}


def _session_is_utc() -> bool:
    from pyspark.sql import SparkSession
    s = SparkSession.getActiveSession()
    if s is None:
        return False
    return (s.conf.get("spark.sql.session.timeZone", "") or "").upper() in _UTC_NAMES


def wall_clock_micros(c: ColumnOrName) -> Column:
    """Microseconds since 1970-01-01 00:00 of the wall-clock reading: the
    arithmetic of naive datetimes, whatever the session time zone. In a UTC
    session (what ``get_spark`` sets) this is the cheap ``unix_micros``;
    otherwise it is assembled from the date and time-of-day fields, so a DST
    change in the session zone cannot shift it."""
    x = _col(c)
    if _session_is_utc():
        return F.unix_micros(x.cast("timestamp"))
    day = F.unix_date(F.to_date(x)).cast("long") * F.lit(MICROS_PER_DAY)
    tod = (F.hour(x).cast("long") * 3_600_000_000 + F.minute(x).cast("long") * 60_000_000
           + (F.date_part(F.lit("SECOND"), x) * 1_000_000).cast("long"))
    return day + tod


def whole_days_between(start: ColumnOrName, end: ColumnOrName) -> Column:
    """Floor of the elapsed wall-clock time in days (``end - start``).

    Exact integer arithmetic on microseconds, independent of the session
    time zone; ``datediff`` would count calendar boundaries instead (23 h
    across midnight gives 1, the floor gives 0).
    """
    us = wall_clock_micros(end) - wall_clock_micros(start)
    return ((us - F.pmod(us, F.lit(MICROS_PER_DAY))) / F.lit(MICROS_PER_DAY)).cast("long")


def clip_lower(c: ColumnOrName, lower: float = 0) -> Column:
    """Values below ``lower`` become ``lower``; null stays null
    (``greatest`` would turn null into the bound)."""
    col = _col(c)
    return F.when(col < lower, F.lit(lower)).otherwise(col)


def repair_duration(date_in: ColumnOrName, date_out: ColumnOrName) -> Column:
    """Whole days from intake to completion, clipped at zero. What is left of a day is cut off and not floored (below zero both end at
    zero), so that the dates stand in the expression once a branch: filters over it would else be too long to be compiled."""
    us = wall_clock_micros(date_out) - wall_clock_micros(date_in)
    return clip_lower(F.call_function("div", us, F.lit(MICROS_PER_DAY)), 0)


def calendar_features(c: ColumnOrName) -> dict[str, Column]:
    """X12-X14 + F8 as named columns, in the feature order used for models."""
    return {
        "Year": year(c),
        "Month": month(c),
        "WeekOfYear": iso_week(c),
        "DayOfWeek": day_of_week(c),
        "Quarter": quarter(c),
        "IsWeekend": is_weekend(c),
    }
