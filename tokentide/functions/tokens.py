"""Token arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schema import (
    CACHE_INCLUSIVE_APPS,
    MAX_TOKEN_COUNT,
    SEMANTICS_FRESH,
    SEMANTICS_LEGACY,
    SEMANTICS_TOTAL,
    TOKEN_COLUMNS,
)

def zero() -> Column:
    return F.lit(0).cast("bigint")


def cache_inclusive(app: Column | None = None) -> Column:
    return (F.col("app_type") if app is None else app).isin(*CACHE_INCLUSIVE_APPS)


def fresh_input() -> Column:
    """Input tokens that were not served from cache, by the row's own marking.

    Marked totals lose both cache parts, unmarked rows only the cache reads, and
    a row whose input is smaller than what would be taken off is kept as it is.
    """
    kind = F.col("input_token_semantics")
    given, read, written = (F.col(c) for c in ("input_tokens", "cache_read_tokens", "cache_creation_tokens"))
    cached = (
        F.when(cache_inclusive() & (kind == SEMANTICS_TOTAL), read + written)
        .when(cache_inclusive() & (kind == SEMANTICS_LEGACY), read)
        .otherwise(zero())
    )
    return F.when((kind != SEMANTICS_FRESH) & (given >= cached), given - cached).otherwise(given)


def real_total() -> Column:
    return fresh_input() + F.col("output_tokens") + F.col("cache_read_tokens") + F.col("cache_creation_tokens")


def billable_input(app: Column | None = None) -> Column:
    """Input tokens charged at the input price; never below zero."""
    net = F.col("input_tokens") - F.col("cache_read_tokens") - F.col("cache_creation_tokens")
    return F.when(cache_inclusive(app), F.greatest(net, zero())).otherwise(F.col("input_tokens"))


def is_billable() -> Column:
    return F.greatest(*[F.col(c) for c in TOKEN_COLUMNS]) > 0


def clamp(value: Column) -> Column:
    return F.greatest(zero(), F.least(value, F.lit(MAX_TOKEN_COUNT).cast("bigint")))


def saturating_minus(current: Column, previous: Column) -> Column:
    return F.greatest(current - F.coalesce(previous, zero()), zero())


def is_success() -> Column:
    return F.col("status_code").between(200, 299)
