"""Hiding session records that the proxy already recorded.

A session record is redundant when a successful proxy record with the same
tokens and a compatible model lies within ten minutes. Joining all pairs would
square a hot token tuple, so the proxy side is first reduced to one row per
match key and ten-minute bucket that keeps just the times needed to decide:
a record in the same bucket is always close enough, of the previous bucket only
the latest matters and of the next one only the earliest. The join then has
equality keys including the bucket, and a session row meets at most one row per
distinct model.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.times import event_date
from ..functions.tokens import is_success
from ..schema import (
    DEDUP_WINDOW_SECONDS,
    OPEN_CACHE_APPS,
    OPEN_CACHE_SOURCES,
    READ_DEDUP_SOURCES,
    SOURCE_PROXY,
)
from ..session import staged
from .filters import UsageQuery, apply_filters, in_range

def _any_cache() -> Column:
    return F.lit(-1).cast("bigint")


def _source() -> Column:
    return F.coalesce(F.col("data_source"), F.lit(SOURCE_PROXY))


def _is_proxy() -> Column:
    """Written as two plain tests so that the file reader can apply them."""
    return F.col("data_source").isNull() | (F.col("data_source") == SOURCE_PROXY)


def bucket_of(seconds: Column, width: int) -> Column:
    """Start of the bucket; integer arithmetic, also right before the epoch."""
    return seconds - F.pmod(seconds, F.lit(width).cast("bigint"))


def near_buckets(df: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Reduce timed rows to (keys, bucket): bounds that decide nearness for that bucket."""
    own = bucket_of(F.col("created_at"), width)
    spread = df.select(
        *keys,
        "created_at",
        own.alias("_own"),
        F.explode(F.array(own - width, own, own + width)).alias("_bucket"),
    )
    at, near = F.col("created_at"), F.col("_bucket") - F.col("_own")
    return spread.groupBy(*keys, "_bucket").agg(
        F.max(F.when(near > 0, at)).alias("_before"),
        F.max(near == 0).alias("_same"),
        F.min(F.when(near < 0, at)).alias("_after"),
    )


def is_near(at: Column, width: int, side: str = "p") -> Column:
    before, same, after = (F.col(f"{side}.{c}") for c in ("_before", "_same", "_after"))
    return same | F.coalesce(at - before <= width, F.lit(False)) | F.coalesce(after - at <= width, F.lit(False))


def _proxy_side(usage: DataFrame, width: int, by_device: bool) -> DataFrame:
    proxies = usage.filter(_is_proxy() & is_success())
    app = F.col("app_type")
    folded = F.when(app == "claude-desktop", F.array(app, F.lit("claude"))).otherwise(F.array(app))
    cache = F.col("cache_creation_tokens")
    keys = ["_app", "_in", "_out", "_read", "_cache", "_model"] + (["_device"] if by_device else [])
    rows = proxies.select(
        F.explode(folded).alias("_app"),
        F.col("input_tokens").alias("_in"),
        F.col("output_tokens").alias("_out"),
        F.col("cache_read_tokens").alias("_read"),
        cache.alias("_written"),
        F.lower("model").alias("_model"),
        "created_at",
        *([F.col("device_id").alias("_device")] if by_device else []),
    ).select("*", F.explode(F.array(F.col("_written"), _any_cache())).alias("_cache"))
    return near_buckets(rows, keys, width)


def drop_proxied(
    rows: DataFrame,
    proxies: DataFrame,
    candidate: Column,
    open_cache: Column,
    *,
    width: int = DEDUP_WINDOW_SECONDS,
    by_device: bool = False,
) -> DataFrame:
    """Anti-join ``rows`` (only those flagged ``candidate``) against proxy records.

    ``open_cache`` marks rows whose zero cache_creation means "not reported".
    """
    near = _proxy_side(proxies, width, by_device)
    left = rows.withColumns(
        {
            "_cand": F.coalesce(candidate, F.lit(False)),
            "_key_cache": F.when(open_cache & (F.col("cache_creation_tokens") == 0), _any_cache()).otherwise(
                F.col("cache_creation_tokens")
            ),
            "_key_bucket": bucket_of(F.col("created_at"), width),
            "_key_model": F.lower("model"),
        }
    )
    s, p = left.alias("s"), near.alias("p")
    unknown = F.lit("unknown")
    cond = (
        (F.col("s.app_type") == F.col("p._app"))
        & (F.col("s.input_tokens") == F.col("p._in"))
        & (F.col("s.output_tokens") == F.col("p._out"))
        & (F.col("s.cache_read_tokens") == F.col("p._read"))
        & (F.col("s._key_cache") == F.col("p._cache"))
        & (F.col("s._key_bucket") == F.col("p._bucket"))
        & F.col("s._cand")
        & (
            (F.col("s._key_model") == F.col("p._model"))
            | (F.col("p._model") == unknown)
            | (F.col("s._key_model") == unknown)
        )
        & is_near(F.col("s.created_at"), width)
    )
    if by_device:
        cond = cond & (F.col("s.device_id") == F.col("p._device"))
    return s.join(p, cond, "left_anti").drop("_cand", "_key_cache", "_key_bucket", "_key_model")


def effective_usage(
    usage: DataFrame,
    q: UsageQuery | None = None,
    *,
    sources: tuple[str, ...] = READ_DEDUP_SOURCES,
    by_device: bool = False,
) -> DataFrame:
    """Rows that reports may count, under a filter.

    The filter narrows the reported rows only. The proxy side ignores it, except
    that proxies of other apps, or further than the window from the asked range,
    cannot matter and are not read.
    """
    q = q or UsageQuery()
    proxies = in_range(usage, q.start, q.end, slack=DEDUP_WINDOW_SECONDS)
    return drop_proxied(
        apply_filters(usage, q),
        apply_filters(proxies, UsageQuery(app_type=q.app_type)),
        _source().isin(*sources),
        _source().isin(*OPEN_CACHE_SOURCES),
        by_device=by_device,
    )


def drop_known(rows: DataFrame, fact: DataFrame) -> DataFrame:
    """Rows whose request_id is not in the fact table yet; reads only that column."""
    return rows.join(fact.select("request_id"), "request_id", "left_anti")


def time_span(rows: DataFrame) -> tuple[int, int] | None:
    """First and last created_at of a batch; None when it is empty."""
    span = rows.agg(F.min("created_at").alias("lo"), F.max("created_at").alias("hi")).first()
    return None if span["lo"] is None else (span["lo"], span["hi"])


def days_around(rows: DataFrame, slack: int) -> DataFrame:
    """The storage days (_day) that hold a time within ``slack`` seconds of a row, written out.

    Far fewer than the rows, and of a size that the planner knows, so a join with them is a
    broadcast below its threshold and picks the stored days while the query runs.
    """
    at = F.col("created_at")
    steps = [event_date(at + d) for d in (*range(-slack, slack, 86400), slack)]
    return staged(rows.select(F.explode(F.array_distinct(F.array(*steps))).alias("_day")).distinct(), "days")


def near_days(fact: DataFrame, days: Callable[[], DataFrame]) -> DataFrame:
    """Rows of ``fact``, stored by day, that lie in one of the days; those without a day always do.

    A table without an event_date is taken as it is.
    """
    if "event_date" not in fact.columns:
        return fact
    # dynamic pruning asks for a filter on the side that prunes; this one holds for every day
    some = days().filter(F.unix_date("_day") >= -(1 << 31))
    dated = fact.filter("event_date is not null").join(some, F.col("event_date") == F.col("_day"), "left_semi")
    return dated.unionByName(fact.filter("event_date is null"))


def effective_days(fact: DataFrame, days: DataFrame) -> DataFrame:
    """Rows that reports may count of some days (_day) of a table stored by day; reads those and their neighbours."""
    beside = days.select(F.explode(F.array(*[F.date_add("_day", d) for d in (-1, 0, 1)])).alias("_day")).distinct()
    return drop_proxied(
        near_days(fact, lambda: days),
        near_days(fact, lambda: beside),
        _source().isin(*READ_DEDUP_SOURCES),
        _source().isin(*OPEN_CACHE_SOURCES),
    )


def ingest_dedup(rows: DataFrame, fact: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """New session rows that are neither present nor already seen by the proxy (any source).

    Over a table stored by day only the days around the batch's own times are read, however
    far apart they lie. ``ids``: stored request ids, if those of the batch's hash buckets
    are known apart (``streaming.pipelines.id_index``); else all of ``fact`` are compared.
    """
    return drop_proxied(
        drop_known(rows, fact if ids is None else ids),
        near_days(fact, lambda: days_around(rows, DEDUP_WINDOW_SECONDS)),
        F.lit(True),
        F.col("app_type").isin(*OPEN_CACHE_APPS),
    )


def drop_near_activity(
    rows: DataFrame, fact: DataFrame, app: str = "grokbuild", *, width: int = DEDUP_WINDOW_SECONDS
) -> DataFrame:
    """Rows with no proxy record of ``app``, of any status or size, within the window."""
    nearby = near_days(fact, lambda: days_around(rows, width))
    proxies = nearby.filter(_is_proxy() & (F.col("app_type") == app)).select("created_at")
    near = near_buckets(proxies, [], width)
    s = rows.withColumn("_key_bucket", bucket_of(F.col("created_at"), width)).alias("s")
    p = near.alias("p")
    cond = (F.col("s._key_bucket") == F.col("p._bucket")) & is_near(F.col("s.created_at"), width)
    return s.join(p, cond, "left_anti").drop("_key_bucket")
