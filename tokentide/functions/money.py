"""Exact money arithmetic in decimals."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schema import MONEY, PRICE
from .tokens import billable_input

def no_money() -> Column:
    return F.lit(0).cast(MONEY)


def _millionth() -> Column:
    return F.lit("0.000001").cast("decimal(6,6)")


def _tick() -> Column:
    return F.lit("0.0000000001").cast("decimal(10,10)")


def component(tokens: Column, per_million: Column) -> Column:
    """tokens x price / 1e6 by multiplication, so the scale stays exact.

    Counts beyond twelve digits, which no log of this package yields, are priced as the largest of twelve.
    """
    priced = F.least(tokens, F.lit(10**12 - 1)).cast("decimal(12,0)")
    return (priced * per_million.cast(PRICE) * _millionth()).cast(MONEY)


def cost_columns(multiplier: Column | None = None) -> dict[str, Column]:
    """The four components and their total; only the total carries the multiplier.

    Expects token, app_type and price columns on the row.
    """
    parts = {
        "input_cost_usd": component(billable_input(), F.col("input_cost_per_million")),
        "output_cost_usd": component(F.col("output_tokens"), F.col("output_cost_per_million")),
        "cache_read_cost_usd": component(F.col("cache_read_tokens"), F.col("cache_read_cost_per_million")),
        "cache_creation_cost_usd": component(
            F.col("cache_creation_tokens"), F.col("cache_creation_cost_per_million")
        ),
    }
    a, b, c, d = parts.values()
    total = a + b + c + d
    if multiplier is not None:
        total = total.cast("decimal(27,18)") * multiplier.cast("decimal(10,4)")
    return {**parts, "total_cost_usd": total.cast(MONEY)}


def per_million(text: Column) -> Column:
    """Price per million from a per-token decimal text; NULL if negative, no number or beyond what a price can hold."""
    plain = F.trim(text)
    value = F.when(plain.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"), plain).try_cast("decimal(24,18)")
    return F.when(value >= 0, (value * F.lit(1000000).cast("decimal(7,0)")).try_cast(PRICE))


def ticks(count: Column) -> Column:
    """Reported cost in ticks of 1e-10; NULL when nothing was reported."""
    return F.when(count > 0, (count.cast("decimal(19,0)") * _tick()).cast(MONEY))


def parse_usd(text: Column) -> Column:
    value = F.regexp_replace(text, ",", "").try_cast("double")
    return F.when((value >= 0) & (value < float("inf")), value)


def decode_text(text: Column) -> Column:
    out = text
    for entity, plain in (("&amp;", "&"), ("&nbsp;", " "), ("&#39;", "'")):  # fixed values
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return F.trim(out)


def report(amount: Column) -> Column:
    """Money as shown in a report: six decimals."""
    return F.round(amount, 6).cast("double")
