"""The overview: all reports under one filter."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.names import provider_name
from ..functions.times import is_hourly
from ..operators import analytics as A, insights as I
from ..operators.dedup import effective_usage, time_span
from ..operators.filters import UsageQuery
from ..session import staged


def _where(c: DataFrame, provider: str | None, model: str | None) -> DataFrame:
    if provider is not None:
        c = c.filter(provider_name() == provider)
    if model is not None:
        c = c.filter(F.col("model") == model)
    return c


def filter_options(usage: DataFrame, q: UsageQuery) -> DataFrame:
    """Provider and model choices: each ignores its own and the narrower filter."""
    view = effective_usage(usage, q.without("provider_name", "model"))
    names = view.groupBy("provider_id", A.effective_model().alias("model")).agg(F.count("*").alias("n"))
    return _options(names, q)


def _options(c: DataFrame, q: UsageQuery) -> DataFrame:
    def choices(df: DataFrame, dimension: str, name: Column, selected: str | None) -> DataFrame:
        out = df.select(F.lit(dimension).alias("dimension"), name.alias("name")).filter(F.col("name") != "")
        if selected:
            own = c.sparkSession.range(1).select(F.lit(dimension).alias("dimension"), F.lit(selected).alias("name"))
            out = out.unionByName(own)
        return out

    providers = choices(c, "provider", provider_name(), q.provider_name)
    models = choices(_where(c, q.provider_name, None), "model", F.col("model"), q.model)
    return providers.unionByName(models).distinct()


def usage_report(usage: DataFrame, q: UsageQuery, page: int = 1, size: int = 10) -> dict[str, DataFrame]:
    """Summary, trends, providers, models, options, insights and a log page.

    One pass over the records builds a small cube, staged once; provider and
    model filters apply to the cube, so the choices come from the same pass. An open
    end of the range is taken from the records.
    """
    view = effective_usage(usage, q.without("provider_name", "model"))
    if q.start is None or q.end is None:
        lo, hi = time_span(view) or (0, 0)
        q = replace(q, start=lo if q.start is None else q.start, end=hi if q.end is None else q.end)
    whole = staged(A.cube(view, is_hourly(q.start, q.end)), "cube")
    c = _where(whole, q.provider_name, q.model)
    summary, trends = A.summary_of(c), A.trends_of(c)
    providers, models = A.providers_of(c), A.models_of(c)
    return {
        "summary": summary,
        "trends": trends,
        "chart": I.trend_chart(trends, q.start, q.end),
        "providers": providers,
        "models": models,
        "options": _options(whole, q),
        "insights": I.insight_feed(summary, trends, providers, models),
        "composition": I.token_composition(summary),
        "log": A.request_log_page(effective_usage(usage, q), page, size),
        "log_total": summary.select(F.col("total_requests").alias("total")),
    }
