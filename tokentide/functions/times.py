"""Epoch seconds, buckets and range presets."""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

from pyspark.sql import Column, functions as F

from ..schema import HOURLY_RANGE_SECONDS

# Fixed pattern: a timestamp text must carry a zone to count.
_RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def rfc3339(text: Column) -> Column:
    """TIMESTAMP of an RFC 3339 text, NULL when it is not one."""
    return F.when(text.rlike(_RFC3339), F.try_to_timestamp(F.upper(text)))


def rfc3339_seconds(text: Column) -> Column:
    return F.unix_seconds(rfc3339(text))


def millis_to_seconds(ms: Column, ingest_ts: int) -> Column:
    """Positive milliseconds as seconds; otherwise the ingest time."""
    return F.when(ms > 0, F.floor(ms / 1000)).otherwise(F.lit(ingest_ts).cast("bigint"))


def mixed_epoch(number: Column, text: Column) -> Column:
    """Integer seconds or milliseconds, or an RFC 3339 text."""
    seconds = F.when(number > 100_000_000_000, F.floor(number / 1000)).otherwise(number)
    return F.coalesce(seconds, rfc3339_seconds(text))


def is_hourly(start: int, end: int) -> bool:
    return end - start <= HOURLY_RANGE_SECONDS


def bucket_start(seconds: Column, hourly: bool) -> Column:
    return F.date_trunc("hour" if hourly else "day", F.timestamp_seconds(seconds))


def bucket_label_of(start: Column, hourly: bool) -> Column:
    return F.date_format(start, "yyyy-MM-dd HH:00:00" if hourly else "yyyy-MM-dd")


def bucket_label(seconds: Column, hourly: bool) -> Column:
    return bucket_label_of(F.timestamp_seconds(seconds), hourly)


def event_date(seconds: Column) -> Column:
    """UTC calendar date used as the storage partition; independent of the session zone.

    NULL for a time beyond 32-bit days.
    """
    return F.date_from_unix_date(F.floor(seconds / 86400).try_cast("int"))


def has_event_date(seconds: int) -> bool:
    """Whether a time has an event_date."""
    return -(1 << 31) <= seconds // 86400 < 1 << 31


def make_range(preset: str, now: int, zone: str = "UTC", start: int | None = None, end: int | None = None):
    """(start, end) seconds of a named range; day presets begin at local midnight."""
    day = 24 * 3600
    tz = ZoneInfo(zone)

    def midnight(ts: int) -> int:
        local = dt.datetime.fromtimestamp(ts, tz)
        return int(local.replace(hour=0, minute=0, second=0, microsecond=0).timestamp())

    days = {"today": 1, "7d": 7, "14d": 14, "30d": 30, "90d": 90}
    if preset in days:
        return midnight(now - (days[preset] - 1) * day), now
    if preset == "1d":
        return now - day, now
    if preset == "all":
        return 946684800, now  # 2000-01-01
    if preset == "custom":
        return (now - 7 * day if start is None else start), (now if end is None else end)
    raise ValueError(f"unknown range preset: {preset}")
