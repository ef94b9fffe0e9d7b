"""Reports over usage records. Each takes rows that are already filtered and effective."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.money import report
from ..functions.names import effective_model, provider_name
from ..functions.times import bucket_label_of, bucket_start, event_date, is_hourly
from ..functions.tokens import fresh_input, is_success, real_total
from ..session import staged

def _total(column: Column | str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0).cast("bigint"))


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part * F.lit(100.0), whole.cast("double"))


def _measures(df: DataFrame) -> DataFrame:
    return df.withColumns({"_fresh": fresh_input(), "_total": real_total()})


def sums(df: DataFrame, *keys: Column | str) -> DataFrame:
    """Additive measures per group."""
    return (
        _measures(df)
        .groupBy(*keys)
        .agg(
            F.count("*").alias("n"),
            F.count_if(is_success()).alias("ok"),
            F.sum("_fresh").alias("fresh"),
            F.sum("output_tokens").alias("output"),
            F.sum("cache_read_tokens").alias("cache_read"),
            F.sum("cache_creation_tokens").alias("cache_creation"),
            F.sum("_total").alias("total"),
            F.sum("total_cost_usd").alias("cost"),
            F.sum("latency_ms").alias("latency"),
        )
    )


def _bucket(hourly: bool) -> Column:
    return bucket_start(F.col("created_at"), hourly).alias("bucket")


def _labelled(c: DataFrame, hourly: bool) -> DataFrame:
    """Bucket starts as text, written once a group and not once a record."""
    return c.withColumn("bucket", bucket_label_of(F.col("bucket"), hourly))


def cube(df: DataFrame, hourly: bool) -> DataFrame:
    """Additive measures per bucket, provider and model.

    All overview reports fold this small table, so one pass over the records
    serves them together. A single report groups by its own key instead.
    """
    return _labelled(sums(df, _bucket(hourly), "provider_id", effective_model().alias("model")), hourly)


def summary_of(c: DataFrame) -> DataFrame:
    cost = F.coalesce(F.sum("cost"), F.lit(0))
    cached_in = F.sum(F.col("fresh") + F.col("cache_creation") + F.col("cache_read"))
    return c.agg(
        _total("n").alias("total_requests"),
        report(cost).alias("total_cost"),
        _total("fresh").alias("input_tokens"),
        _total("output").alias("output_tokens"),
        _total("cache_read").alias("cache_read_tokens"),
        _total("cache_creation").alias("cache_creation_tokens"),
        _total("total").alias("real_total_tokens"),
        F.round(F.coalesce(percent(F.sum("ok"), F.sum("n")), F.lit(0.0)), 6).alias("success_rate"),
        F.round(F.coalesce(percent(F.sum("cache_read"), cached_in), F.lit(0.0)), 6).alias("cache_hit_rate"),
    )


def trends_of(c: DataFrame) -> DataFrame:
    return (
        c.groupBy(F.col("bucket").alias("date"))
        .agg(
            F.sum("n").alias("request_count"),
            report(F.sum("cost")).alias("total_cost"),
            F.sum("total").alias("total_tokens"),
            F.sum("fresh").alias("input_tokens"),
            F.sum("output").alias("output_tokens"),
            F.sum("cache_read").alias("cache_read_tokens"),
            F.sum("cache_creation").alias("cache_creation_tokens"),
        )
        .orderBy("date")
    )


def providers_of(c: DataFrame) -> DataFrame:
    return (
        c.groupBy("provider_id")
        .agg(
            provider_name().alias("provider_name"),
            F.sum("n").alias("request_count"),
            F.sum("total").alias("total_tokens"),
            report(F.sum("cost")).alias("total_cost"),
            F.round(percent(F.sum("ok"), F.sum("n")), 6).alias("success_rate"),
            F.round(F.coalesce(F.try_divide(F.sum("latency").cast("double"), F.sum("n")), F.lit(0.0)), 6).alias(
                "avg_latency_ms"
            ),
        )
        .orderBy(F.desc("total_cost"), "provider_id")
    )


def models_of(c: DataFrame) -> DataFrame:
    return (
        c.groupBy("model")
        .agg(
            F.sum("n").alias("request_count"),
            F.sum("total").alias("total_tokens"),
            report(F.sum("cost")).alias("total_cost"),
            F.round(F.try_divide(F.sum("cost").cast("double"), F.sum("n")), 6).alias("avg_cost_per_request"),
        )
        .orderBy(F.desc("total_cost"), "model")
    )


def usage_summary(df: DataFrame) -> DataFrame:
    rows = _measures(df).select(
        F.lit(1).cast("bigint").alias("n"),
        is_success().cast("int").alias("ok"),
        F.col("_fresh").alias("fresh"),
        F.col("output_tokens").alias("output"),
        F.col("cache_read_tokens").alias("cache_read"),
        F.col("cache_creation_tokens").alias("cache_creation"),
        F.col("_total").alias("total"),
        F.col("total_cost_usd").alias("cost"),
    )
    return summary_of(rows)


def usage_trends(df: DataFrame, start: int, end: int) -> DataFrame:
    """By hour for ranges up to two days, else by day, in the session time zone."""
    hourly = is_hourly(start, end)
    return trends_of(_labelled(sums(df, _bucket(hourly)), hourly))


def provider_stats(df: DataFrame) -> DataFrame:
    return providers_of(sums(df, "provider_id"))


def model_stats(df: DataFrame) -> DataFrame:
    """Grouped by the effective (pricing) model."""
    return models_of(sums(df, effective_model().alias("model")))


LOG_COLUMNS = (
    "request_id",
    "provider_id",
    "provider_name",
    "app_type",
    "model",
    "request_model",
    "pricing_model",
    "input_tokens",
    "fresh_input_tokens",
    "output_tokens",
    "cache_read_tokens",
    "cache_creation_tokens",
    "total_cost_usd",
    "input_cost_usd",
    "output_cost_usd",
    "cache_read_cost_usd",
    "cache_creation_cost_usd",
    "latency_ms",
    "status_code",
    "error_message",
    "session_id",
    "is_streaming",
    "cost_multiplier",
    "created_at",
    "data_source",
)


def log_rows(df: DataFrame) -> DataFrame:
    return df.withColumns({"provider_name": provider_name(), "fresh_input_tokens": fresh_input()}).select(
        *LOG_COLUMNS
    )


MAX_PAGE = 100


def page_bounds(page: int, size: int, max_size: int = MAX_PAGE) -> tuple[int, int]:
    """Offset and size of a page; a larger page than ``max_size`` is refused, not cut."""
    size = size or 10
    if size > max_size:
        raise ValueError(f"a page has at most {max_size} rows, {size} were asked for")
    return (max(page, 1) - 1) * size, size


def request_log_page(df: DataFrame, page: int = 1, size: int = 10, max_size: int = MAX_PAGE) -> DataFrame:
    """A page of the log, newest first; a top-k, so no total sort runs."""
    offset, size = page_bounds(page, size, max_size)
    return log_rows(df).orderBy(F.desc("created_at"), "request_id").offset(offset).limit(size)


#: Rows that a page's range of time may hold before it is narrowed further.
PAGE_ROWS = 100_000


def page_range(df: DataFrame, offset: int, size: int, rows: int = PAGE_ROWS) -> tuple[int, int, int] | None:
    """(first second, last second, rows to skip in it) of the time that holds some rows, newest first; None if none do.

    Rows are counted by second, in the only pass over them; the counts are added up by day, and while
    the days hit hold more than ``rows`` by hour, minute and second within them.
    """
    low, high = None, None
    seconds = staged(df.groupBy("created_at").agg(F.count("*").alias("_n")), "page-seconds")
    for width in (86400, 3600, 60, 1):
        part = seconds if low is None else seconds.filter(F.col("created_at").between(low, high))
        counts = part.groupBy(F.floor(F.col("created_at") / width).alias("_at")).agg(F.sum("_n").alias("_n"))
        newer = Window.orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each unit of time
        placed = counts.withColumn("_before", F.coalesce(F.sum("_n").over(newer), F.lit(0)))
        hit = placed.filter((F.col("_before") < offset + size) & (F.col("_before") + F.col("_n") > offset))
        found = hit.agg(F.min("_at"), F.max("_at"), F.min("_before"), F.sum("_n")).first()
        if found[0] is None:
            return None
        low, high, offset = found[0] * width, (found[1] + 1) * width - 1, offset - found[2]
        if found[3] <= rows:
            break
    return low, high, offset


def request_log_deep(df: DataFrame, page: int, size: int = 10, max_size: int = MAX_PAGE, rows: int = PAGE_ROWS) -> DataFrame:
    """As ``request_log_page``, for pages far down: counts find the page's range of time, and only that is sorted."""
    offset, size = page_bounds(page, size, max_size)
    found = page_range(df, offset, size, rows)
    if found is None:
        return log_rows(df.filter("false"))
    low, high, skip = found
    part = df.filter(F.col("created_at").between(low, high))
    return log_rows(part).orderBy(F.desc("created_at"), "request_id").offset(skip).limit(size)


def request_log_after(
    df: DataFrame, created_at: int, request_id: str, size: int = 10, max_size: int = MAX_PAGE
) -> DataFrame:
    """The page after a given row, for deep paging without an offset."""
    older = (F.col("created_at") < created_at) | (
        (F.col("created_at") == created_at) & (F.col("request_id") > request_id)
    )
    return log_rows(df.filter(older)).orderBy(F.desc("created_at"), "request_id").limit(page_bounds(1, size, max_size)[1])


def log_total(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))


def request_detail(usage: DataFrame, request_id: str) -> DataFrame:
    """One record by id; also shows records that reports hide as duplicates."""
    return log_rows(usage.filter(F.col("request_id") == request_id)).limit(1)


def device_stats(usage: DataFrame, local_id: str, local_name: str) -> DataFrame:
    """Devices with the local one first; it is listed even without records."""
    seen = usage.filter(F.col("device_id") != "").groupBy("device_id").agg(
        F.max("device_name").alias("_name"), F.count("*").alias("request_count"), F.max("created_at").alias("last_seen")
    )
    local = usage.sparkSession.range(1).select(
        F.lit(local_id).alias("device_id"),
        F.lit(local_name).alias("_name"),
        F.lit(0).cast("bigint").alias("request_count"),
        F.lit(None).cast("bigint").alias("last_seen"),
    )
    absent = local.join(seen.select("device_id"), "device_id", "left_anti").select(*seen.columns)
    return (
        seen.unionByName(absent)
        .select(
            "device_id",
            F.coalesce(F.nullif(F.col("_name"), F.lit("")), F.col("device_id")).alias("device_name"),
            (F.col("device_id") == local_id).alias("is_local"),
            "request_count",
            "last_seen",
        )
        .orderBy(F.desc("is_local"), "device_name", "device_id")
    )


def daily_rollup(usage: DataFrame) -> DataFrame:
    """Aggregate table per day, app, provider and models."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return usage.groupBy(
        event_date(F.col("created_at")).cast("string").alias("date"),
        "app_type",
        "provider_id",
        "model",
        blank("request_model").alias("request_model"),
        blank("pricing_model").alias("pricing_model"),
    ).agg(
        F.count("*").alias("request_count"),
        F.count_if(is_success()).alias("success_count"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum("cache_read_tokens").alias("cache_read_tokens"),
        F.sum("cache_creation_tokens").alias("cache_creation_tokens"),
        report(F.sum("total_cost_usd")).alias("total_cost_usd"),
        F.round(F.avg("latency_ms")).cast("bigint").alias("avg_latency_ms"),
    )


def profile_usage(usage: DataFrame, top: int = 10) -> DataFrame:
    """Row count, time span, rows per source, unpriced rows per model, dearest models.

    One pass: all sections fold a table of source x model sums.
    """
    base = usage.groupBy("data_source", "model").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("total_cost_usd") == 0).alias("unpriced"),
        F.sum("total_cost_usd").alias("cost"),
        F.min("created_at").alias("lo"),
        F.max("created_at").alias("hi"),
    )
    none = F.lit(None).cast("string")

    def section(df: DataFrame, name: str, key: Column, value: Column) -> DataFrame:
        return df.select(F.lit(name).alias("section"), key.alias("key"), value.cast("double").alias("value"))

    whole = base.agg(
        _total("n").alias("rows"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), _total("unpriced").alias("unpriced")
    )
    overall = whole.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(n).alias("section"), F.col(c).cast("double").alias("value"))
                    for n, c in (
                        ("rows", "rows"),
                        ("first_created_at", "lo"),
                        ("last_created_at", "hi"),
                        ("zero_cost_rows", "unpriced"),
                    )
                ]
            )
        ).alias("x")
    ).select("x.section", none.alias("key"), "x.value")
    sources = base.groupBy("data_source").agg(F.sum("n").alias("v"))
    unpriced = base.groupBy("model").agg(F.sum("unpriced").alias("v")).filter("v > 0")
    dear = base.groupBy("model").agg(F.sum("cost").alias("v")).orderBy(F.desc("v"), "model").limit(top)
    return (
        overall.unionByName(section(sources, "rows_by_source", F.col("data_source"), F.col("v")))
        .unionByName(section(unpriced, "zero_cost_by_model", F.col("model"), F.col("v")))
        .unionByName(section(dear, "top_models_by_cost", F.col("model"), report(F.col("v"))))
    )


def price_ranges(models: DataFrame, points: DataFrame) -> DataFrame:
    """Lowest and highest measured price of each model among reliable benchmark points."""
    per_model = (
        points.filter((F.col("total") >= 30) & F.col("average_price_usd").isNotNull())
        .groupBy(F.lower("model").alias("_key"))
        .agg(F.min("average_price_usd").alias("low_price"), F.max("average_price_usd").alias("high_price"))
    )
    key = F.lower(F.substring_index("model", "/", -1))
    return models.withColumn("_key", key).join(per_model, "_key", "left").drop("_key")


def cost_shares(c: DataFrame) -> DataFrame:
    """Model reports with the share of the whole cost and a bar scaled to the dearest model.

    Two numbers over all models come to the driver; the models stay where they are.
    """
    per_model = c.groupBy("model").agg(F.sum("n").alias("request_count"), F.sum("cost").alias("_cost"))
    costs = staged(per_model.withColumn("total_cost", report(F.col("_cost"))), "model-costs")
    top = costs.agg(report(F.sum("_cost")).alias("whole"), F.max("total_cost").alias("dearest")).first()
    whole, dearest = top["whole"] or 0.0, max(top["dearest"] or 0.0, 1.0)
    share = F.col("total_cost") / whole * 100 if whole > 0 else F.lit(0.0)
    return costs.select(
        "model",
        "request_count",
        "total_cost",
        F.round(share, 6).alias("share"),
        F.round(F.col("total_cost") / dearest * 100, 6).alias("bar"),
    )
