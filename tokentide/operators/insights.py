"""Figures derived from reports.

Everything here works on results that are already one row per bucket, model or
provider; the windows without a partition run over such rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.times import is_hourly
from ..schema import GAP_FILL_RANGE_SECONDS
from .analytics import percent

_CHART = {
    "cost": "total_cost",
    "requests": "request_count",
    "total": "total_tokens",
    "input": "input_tokens",
    "output": "output_tokens",
    "cache_creation": "cache_creation_tokens",
    "cache_read": "cache_read_tokens",
}


def trend_chart(trends: DataFrame, start: int, end: int) -> DataFrame:
    """Trend points with empty buckets filled in, and the running token total.

    Ranges beyond ninety days are not filled.
    """
    hourly = is_hourly(start, end)
    key_length = 13 if hourly else 10
    points = trends.select(
        F.left("date", F.lit(key_length)).alias("bucket"), *[F.col(c).alias(n) for n, c in _CHART.items()]
    )
    if hourly or end - start <= GAP_FILL_RANGE_SECONDS:
        unit = "hour" if hourly else "day"
        spine = trends.sparkSession.range(1).select(
            F.explode(
                F.sequence(
                    F.date_trunc(unit, F.timestamp_seconds(F.lit(start))),
                    F.timestamp_seconds(F.lit(end)),
                    F.expr(f"interval 1 {unit}"),
                )
            ).alias("at")
        )
        pattern = "yyyy-MM-dd HH" if hourly else "yyyy-MM-dd"
        points = spine.select(F.date_format("at", pattern).alias("bucket")).join(points, "bucket", "left").na.fill(0)
    upto = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return points.withColumn("cumulative", F.sum("total").over(upto)).orderBy("bucket")


def _active() -> Column:
    return (F.col("request_count") > 0) | (F.col("total_cost") > 0)


def trend_delta(trends: DataFrame) -> DataFrame:
    """Percent change of cost between the last two active buckets; NULL without a base."""
    ends = trends.filter(_active()).orderBy(F.desc("date")).limit(2).agg(
        F.count("*").alias("_n"),
        F.max_by("total_cost", "date").alias("latest_cost"),
        F.min_by("total_cost", "date").alias("_first"),
    )
    previous = F.when(F.col("_n") == 2, F.col("_first"))
    change = F.when(previous > 0, (F.col("latest_cost") - previous) / previous * 100)
    return ends.select(
        previous.alias("previous_cost"), "latest_cost", F.round(change, 6).alias("trend_delta")
    )


def activity_rhythm(trends: DataFrame, buckets: int = 12) -> DataFrame:
    """The last active buckets scaled to the busiest; the first busiest is the peak."""
    recent = trends.filter(_active()).orderBy(F.desc("date")).limit(buckets)
    everything = Window.partitionBy()
    top = F.greatest(F.max("request_count").over(everything), F.lit(1))
    peak = F.max_by("date", F.struct(F.col("request_count"), -F.unix_seconds(F.to_timestamp("date")))).over(everything)
    return recent.select(
        "date",
        "request_count",
        F.round(F.greatest(F.lit(8.0), F.col("request_count") * F.lit(100.0) / top), 6).alias("height"),
        (F.col("date") == peak).alias("is_peak"),
    ).orderBy("date")


def trend_strip(chart: DataFrame) -> DataFrame:
    """Range total, first peak bucket, active buckets and requests of a chart."""
    live = (F.col("requests") > 0) | (F.col("total") > 0) | (F.col("cost") > 0)
    first_max = F.min_by(F.struct("bucket", "total"), F.struct(-F.col("total"), F.col("bucket")))
    out = chart.agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("total_tokens"),
        F.count_if(live).alias("active_buckets"),
        F.coalesce(F.sum(F.when(live, F.col("requests"))), F.lit(0)).alias("total_requests"),
        first_max.alias("_peak"),
    )
    has_data = F.col("active_buckets") > 0
    return out.select(
        "total_tokens",
        "active_buckets",
        "total_requests",
        F.when(has_data, F.col("_peak.bucket")).alias("peak_bucket"),
        F.when(has_data, F.col("_peak.total")).alias("peak_tokens"),
    )


def token_composition(summary: DataFrame) -> DataFrame:
    """Share of each token kind; no rows when there are no tokens."""
    kinds = {
        "input": "input_tokens",
        "output": "output_tokens",
        "cache_read": "cache_read_tokens",
        "cache_write": "cache_creation_tokens",
    }
    whole = sum((F.col(c) for c in kinds.values()), F.lit(0))
    parts = F.array(
        *[
            F.struct(F.lit(i).alias("ordinal"), F.lit(n).alias("part"), F.col(c).alias("tokens"))
            for i, (n, c) in enumerate(kinds.items())
        ]
    )
    return (
        summary.select(whole.alias("_whole"), F.explode(parts).alias("_p"))
        .filter(F.col("_whole") > 0)
        .select("_p.*", F.round(percent(F.col("_p.tokens"), F.col("_whole")), 6).alias("share"))
    )


def health(rate: Column) -> Column:
    return F.when(rate >= 99, F.lit("good")).when(rate >= 95, F.lit("stable")).otherwise(F.lit("watch"))


def top_models(shared: DataFrame, n: int = 3) -> DataFrame:
    return shared.orderBy(F.desc("total_cost"), "model").limit(n)


def top_providers(providers: DataFrame, n: int = 3) -> DataFrame:
    return providers.orderBy(F.desc("request_count"), "provider_id").limit(n)


def insight_cards(summary: DataFrame, trends: DataFrame) -> DataFrame:
    """Average request cost, cache use, success and momentum in one row."""
    parts = summary.select(
        F.round(F.try_divide(F.col("total_cost"), F.col("total_requests")), 6).alias("average_cost"),
        "cache_hit_rate",
        "cache_read_tokens",
        "success_rate",
    )
    return _beside(parts, trend_delta(trends).select("trend_delta"))


def _beside(*singles: DataFrame) -> DataFrame:
    """Put one-row (or empty) frames side by side, by aggregating their union."""
    columns = [c for df in singles for c in df.columns]
    stacked = None
    for df in singles:
        stacked = df if stacked is None else stacked.unionByName(df, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in columns])


def insight_feed(summary: DataFrame, trends: DataFrame, providers: DataFrame, models: DataFrame) -> DataFrame:
    """At most four findings in a fixed order, or the note that there is no data."""
    best_model = top_models(models, 1).select(
        F.col("model").alias("_model"), F.col("total_cost").alias("_model_cost")
    )
    best_provider = top_providers(providers, 1).select(
        F.col("provider_name").alias("_provider"),
        F.col("request_count").alias("_provider_requests"),
        F.col("success_rate").alias("_provider_rate"),
    )
    row = _beside(
        summary.select("total_cost", "total_requests", "cache_hit_rate", "success_rate", "real_total_tokens"),
        trend_delta(trends).select("trend_delta"),
        best_model,
        best_provider,
    )

    def finding(when: Column, kind: Column | str, tone: Column | str, subject: Column, value: Column) -> Column:
        as_col = lambda x: F.lit(x) if isinstance(x, str) else x
        return F.when(
            when,
            F.struct(
                as_col(kind).alias("kind"),
                as_col(tone).alias("tone"),
                subject.cast("string").alias("subject"),
                F.round(value.cast("double"), 6).alias("value"),
            ),
        )

    none, delta, hit = F.lit(None), F.col("trend_delta"), F.col("cache_hit_rate")
    good = hit >= 20
    found = F.array_compact(
        F.array(
            finding(
                F.col("_model").isNotNull() & (F.col("total_cost") > 0),
                "top_model",
                "violet",
                F.col("_model"),
                percent(F.col("_model_cost"), F.col("total_cost")),
            ),
            finding(
                F.col("real_total_tokens") > 0,
                F.when(good, F.lit("cache_good")).otherwise(F.lit("cache_watch")),
                F.when(good, F.lit("emerald")).otherwise(F.lit("amber")),
                none,
                hit,
            ),
            finding(
                F.col("_provider").isNotNull(),
                "top_provider",
                F.when(F.col("success_rate") >= 95, F.lit("cyan")).otherwise(F.lit("amber")),
                F.col("_provider"),
                F.col("_provider_rate"),
            ),
            finding(
                delta.isNotNull(),
                "trend",
                F.when(delta > 0, F.lit("amber")).otherwise(F.lit("cyan")),
                F.when(delta > 0, F.lit("up")).otherwise(F.lit("down")),
                F.abs(delta),
            ),
        )
    )
    empty = F.array(finding(F.lit(True), "no_data", "cyan", none, none))
    feed = F.when((F.size(found) == 0) & (F.col("total_requests") == 0), empty).otherwise(found)
    return row.select(F.posexplode(F.slice(feed, 1, 4)).alias("ordinal", "_f")).select("ordinal", "_f.*")
