"""Hours, clocks and cyclic calendar features."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from vayuspark.vocab import LOCAL_ZONE


def as_ts(value) -> Column:
    """A timestamp column from a column, a datetime or text."""
    return value.cast("timestamp") if isinstance(value, Column) else F.lit(value).cast("timestamp")


def hour_number(ts: Column) -> Column:
    """Whole hours since 1970, the position of an hour on the axis."""
    return F.floor(F.unix_timestamp(ts) / 3600).cast("long")


def hour_ts(number: Column) -> Column:
    return F.timestamp_seconds(number * 3600)


def floor_hour(ts: Column) -> Column:
    return F.date_trunc("hour", ts)


def hours(n) -> Column:
    n = n if isinstance(n, Column) else F.lit(n)
    return F.make_dt_interval(hours=n.cast("int"))


def days(n: int) -> Column:
    return F.make_dt_interval(days=F.lit(n))


def _cycle(x: Column, period: float) -> tuple[Column, Column]:
    angle = x * F.lit(2 * math.pi) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def local_calendar(ts: Column) -> dict[str, Column]:
    """Cyclic hour, weekday and year day on the local clock: traffic and cooking follow it."""
    local = F.from_utc_timestamp(ts, LOCAL_ZONE)
    weekday = F.weekday(local)
    out = {}
    for name, x, period in (
        ("hour", F.hour(local), 24), ("dow", weekday, 7), ("doy", F.dayofyear(local), 365.25),
    ):
        out[f"{name}_sin"], out[f"{name}_cos"] = _cycle(x.cast("double"), period)
    out["is_weekend"] = (weekday >= 5).cast("double")
    return out


def utc_calendar(ts: Column) -> dict[str, Column]:
    """Cyclic UTC hour and month, for the gap-filling model."""
    out = {}
    for name, x, period in (("hour", F.hour(ts), 24), ("month", F.month(ts), 12)):
        out[f"{name}_sin"], out[f"{name}_cos"] = _cycle(x.cast("double"), period)
    return out


def display_time(ts: Column) -> Column:
    """Local clock text for people, such as `05 Jan, 09:30 am`."""
    return F.lower(F.date_format(F.from_utc_timestamp(ts, LOCAL_ZONE), "dd MMM, hh:mm a"))
