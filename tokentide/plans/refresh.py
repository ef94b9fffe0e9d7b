"""Price refresh followed by re-pricing."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.pricing import recost, recost_metrics, refresh_status, refreshed_prices
from ..session import staged
from ..sources.landed import require_rows


def refresh_prices(usage: DataFrame, prices: DataFrame, catalog: DataFrame, fetched_at: int) -> tuple[DataFrame, DataFrame]:
    """(new price table, one-row status) from a landed catalog; an empty catalog is an error, not an update of nothing."""
    require_rows(catalog, "the price catalog has no entries")
    fresh = staged(refreshed_prices(usage, prices, catalog, fetched_at), "prices")
    return fresh, refresh_status(usage, prices, catalog, fetched_at)


def refresh_and_recost(
    usage: DataFrame, prices: DataFrame, catalog: DataFrame, fetched_at: int
) -> dict[str, DataFrame]:
    fresh, status = refresh_prices(usage, prices, catalog, fetched_at)
    recosted = recost(usage, fresh)
    return {
        "prices": fresh,
        "status": status,
        "usage": recosted.drop("recost_status"),
        "metrics": recost_metrics(recosted),
    }
