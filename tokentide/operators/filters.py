"""The filter object shared by all reports."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

from ..functions.names import effective_model, provider_name
from ..functions.times import event_date, has_event_date


@dataclass(frozen=True)
class UsageQuery:
    start: int | None = None
    end: int | None = None
    app_type: str | None = None
    provider_name: str | None = None
    model: str | None = None
    device_id: str | None = None
    status_code: int | None = None

    def without(self, *names: str) -> "UsageQuery":
        return replace(self, **{n: None for n in names})


def in_range(df: DataFrame, start: int | None, end: int | None, slack: int = 0) -> DataFrame:
    """Inclusive range on created_at; also prunes event_date partitions when stored so.

    Rows with a time that no date can hold are stored without an event_date. Only a range
    with two dated ends rules them out; an end without a date prunes nothing.
    """
    dated = "event_date" in df.columns
    low, high = None if start is None else start - slack, None if end is None else end + slack
    closed = all(at is not None and has_event_date(at) for at in (low, high))
    day = F.col("event_date")
    if low is not None:
        df = df.filter(F.col("created_at") >= low)
        if dated and has_event_date(low):
            within = day >= event_date(F.lit(low))
            df = df.filter(within if closed else within | day.isNull())
    if high is not None:
        df = df.filter(F.col("created_at") <= high)
        if dated and has_event_date(high):
            within = day <= event_date(F.lit(high))
            df = df.filter(within if closed else within | day.isNull())
    return df


def apply_filters(df: DataFrame, q: UsageQuery | None) -> DataFrame:
    if q is None:
        return df
    df = in_range(df, q.start, q.end)
    if q.app_type is not None:
        apps = ["claude", "claude-desktop"] if q.app_type == "claude" else [q.app_type]
        df = df.filter(F.col("app_type").isin(*apps))
    if q.provider_name is not None:
        df = df.filter(provider_name() == q.provider_name)
    if q.model is not None:
        df = df.filter(effective_model() == q.model)
    if q.device_id is not None:
        df = df.filter(F.col("device_id") == q.device_id)
    if q.status_code is not None:
        df = df.filter(F.col("status_code") == q.status_code)
    return df
