"""Zone-free timestamp helpers. Every stored time is naive UTC (TIMESTAMP_NTZ)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

HOME_ZONE = "Asia/Shanghai"


def moment(value: Column | datetime | str) -> Column:
    """A naive UTC timestamp column from a column, a naive datetime or an ISO string.

    Literals go through text, so neither the Python nor the session zone can shift them.
    """
    if isinstance(value, Column):
        return value
    text = value.isoformat(sep=" ") if isinstance(value, datetime) else str(value)
    return F.lit(text).cast("timestamp_ntz")


def to_naive_utc(ts: Column, zone: Column | str | None) -> Column:
    """Local wall time in ``zone`` as naive UTC; a missing zone means already naive UTC."""
    zone = F.lit(zone) if isinstance(zone, str) or zone is None else zone
    return F.when(zone.isNull(), ts).otherwise(F.convert_timezone(zone, F.lit("UTC"), ts))


def month_start_utc(now: Column | datetime | str, zone: str = HOME_ZONE) -> Column:
    """Start of the current local month, in naive UTC."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), moment(now))
    start = F.date_trunc("month", local).cast("timestamp_ntz")
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), start)


def days_before(now: Column | datetime | str, days: int) -> Column:
    return moment(now) - F.make_dt_interval(F.lit(days))


def days_after(now: Column | datetime | str, days: int) -> Column:
    return moment(now) + F.make_dt_interval(F.lit(days))


def whole_seconds_between(start: Column, end: Column) -> Column:
    """ceil(max(0, end - start)) in seconds, null when either side is missing."""
    micros = F.timestamp_diff("MICROSECOND", start, end)
    seconds = F.ceil(F.greatest(micros, F.lit(0)) / F.lit(1_000_000)).cast("int")
    return F.when(micros.isNotNull(), seconds)
