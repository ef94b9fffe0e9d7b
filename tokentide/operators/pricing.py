"""Price lookup, re-pricing and price-catalog matching.

Price tables are joined without a broadcast hint: Spark broadcasts them while
they stay below its own size threshold, so usage rows are not moved by their model
(a few values), and shuffles (with skew handling) beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.money import cost_columns, no_money, per_million
from ..functions.names import catalog_key, strip_day
from ..schema import (
    COST_COLUMNS,
    PRICE_COLUMNS,
    PRICE_SOURCE_BUILTIN,
    PRICE_SOURCE_LIVE,
    PRICING_SCHEMA,
    SESSION_SOURCES,
)
from ..session import staged
from ..sources.seed_prices import SEED_PRICES
from .merge import upsert


def seed_prices(spark: SparkSession) -> DataFrame:
    # literals, not a frame of Python rows: their size is known, so lookups are broadcast
    names = ("model_id", "display_name", *PRICE_COLUMNS)
    rows = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, price, strict=True)]) for price in SEED_PRICES]
    raw = spark.range(1).select(F.inline(F.array(*rows)))
    full = raw.withColumns(
        {"price_source": F.lit(PRICE_SOURCE_BUILTIN), "price_fetched_at": F.lit(None).cast("bigint")}
    )
    return full.select(*[F.col(f.name).cast(f.dataType) for f in PRICING_SCHEMA])


def add_seed_prices(prices: DataFrame) -> DataFrame:
    """Bundled prices fill the models the table does not have."""
    missing = seed_prices(prices.sparkSession).join(prices.select("model_id"), "model_id", "left_anti")
    return prices.unionByName(missing.select(*prices.columns))


def price_list(prices: DataFrame) -> DataFrame:
    return prices.orderBy("model_id")


def price_cache_summary(prices: DataFrame) -> DataFrame:
    live = F.count_if(F.col("price_source") == PRICE_SOURCE_LIVE)
    return prices.agg(
        F.count("*").alias("model_count"),
        live.alias("live_models"),
        (F.count("*") - live).alias("fallback_models"),
        F.coalesce(F.max("price_fetched_at"), F.lit(0)).alias("latest_fetched_at"),
    )


def _by_key(prices: DataFrame, key: Column, prefix: str) -> DataFrame:
    """One row of prices per lookup key; the smallest model_id decides between twins."""
    pick = F.min_by(F.struct("model_id", *PRICE_COLUMNS), F.col("model_id")).alias(prefix)
    return prices.groupBy(key.alias(f"{prefix}_key")).agg(pick)


def with_prices(rows: DataFrame, prices: DataFrame, *, normalized: bool = False) -> DataFrame:
    """Attach priced_as and the four prices; NULL when the model has no price.

    The model's own name is tried first, then the name without its date, both
    ignoring case. ``normalized`` also accepts names equal as catalog keys.
    """
    # the same frame on both sides of the rows, so that it is grouped and sent once
    exact = _by_key(prices, F.lower("model_id"), "_price")
    stripped = strip_day(F.col("model"))
    out = rows.withColumns(
        {
            "_exact_key": F.lower("model"),
            "_undated_key": F.when(stripped != F.col("model"), F.lower(stripped)),
        }
    )
    out = out.join(exact.alias("_e"), F.col("_exact_key") == F.col("_e._price_key"), "left")
    out = out.join(exact.alias("_u"), F.col("_undated_key") == F.col("_u._price_key"), "left")
    found = F.coalesce(F.col("_e._price"), F.col("_u._price"))
    if normalized:
        loose = _by_key(prices, catalog_key(F.col("model_id")), "_loose")
        out = out.withColumn("_loose_key", catalog_key(F.col("model"))).join(loose, "_loose_key", "left")
        found = F.coalesce(found, F.col("_loose"))
    out = out.withColumn("_found", found)
    return out.select(
        *[F.col(c) for c in rows.columns],
        F.col("_found.model_id").alias("priced_as"),
        *[F.col(f"_found.{c}").alias(c) for c in PRICE_COLUMNS],
    )


def price_usage(rows: DataFrame, prices: DataFrame, **lookup) -> DataFrame:
    """Set the cost columns of freshly read session rows.

    Optional columns steer tool-reported cost: ``reported_cost`` (NULL if none),
    ``reported_replaces`` ("all": zero components and the reported total;
    "total": keep components) and ``reported_partial``.
    """
    priced = with_prices(rows, prices, **lookup)
    found = F.col("priced_as").isNotNull()
    costs = {n: F.when(found, c).otherwise(no_money()) for n, c in cost_columns().items()}
    if "reported_cost" in rows.columns:
        reported, whole = F.col("reported_cost"), F.col("reported_replaces") == "all"
        trusted = reported.isNotNull() & (~found | ~F.col("reported_partial") | whole)
        for name in COST_COLUMNS[:4]:
            costs[name] = F.when(reported.isNotNull() & whole, no_money()).otherwise(costs[name])
        costs["total_cost_usd"] = F.when(trusted, reported).otherwise(costs["total_cost_usd"])
    drop = [*PRICE_COLUMNS, "priced_as", "reported_cost", "reported_replaces", "reported_partial"]
    return priced.withColumns(costs).drop(*drop)


def recost(
    usage: DataFrame,
    prices: DataFrame,
    *,
    only_zero: bool = False,
    preserve_reported: bool = False,
    **lookup,
) -> DataFrame:
    """Re-price session rows; adds recost_status (updated, skipped, NULL = not a candidate).

    Rows without a price keep their cost, proxy rows are never touched. By
    default tool-reported totals are replaced too; ``preserve_reported`` keeps
    totals that stand on zero components.
    """
    candidate = F.col("data_source").isin(*SESSION_SOURCES)
    if only_zero:
        candidate = candidate & (F.col("total_cost_usd") == 0)
    if preserve_reported:
        components = F.greatest(*[F.col(c) for c in COST_COLUMNS[:4]])
        candidate = candidate & ~((F.col("total_cost_usd") > 0) & (components == 0))
    candidate = F.coalesce(candidate, F.lit(False))
    priced = with_prices(usage, prices, **lookup)
    change = candidate & F.col("priced_as").isNotNull()
    status = F.when(change, F.lit("updated")).when(candidate, F.lit("skipped"))
    new = {n: F.when(change, c).otherwise(F.col(n)) for n, c in cost_columns().items()}
    return priced.withColumns({"recost_status": status, **new}).drop("priced_as", *PRICE_COLUMNS)


def recost_metrics(recosted: DataFrame) -> DataFrame:
    return recosted.agg(
        F.count_if(F.col("recost_status") == "updated").alias("updated"),
        F.count_if(F.col("recost_status") == "skipped").alias("skipped"),
    )


# --- catalog ------------------------------------------------------------------


def _keys(column: str) -> Column:
    key = catalog_key(F.col(column))
    return F.explode(F.array_distinct(F.array(key, strip_day(key))))


def match_catalog(models: DataFrame, catalog: DataFrame) -> DataFrame:
    """Models of ``model_id`` with the one catalog entry of the same name.

    Two names agree when they share a key, with or without the date. Entries of
    another price tier (a ':' in the id) do not take part, and a model that fits
    two entries fits none. Each key keeps only its smallest and largest entry
    number, which is enough to tell one entry from several.
    """
    entries = catalog.filter(~F.col("id").contains(":"))
    numbers = [F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")]
    keyed = entries.select(_keys("id").alias("_key"), F.col("entry_no").alias("_lo"), F.col("entry_no").alias("_hi"))
    per_key = keyed.groupBy("_key").agg(*numbers)
    hits = models.select("model_id", _keys("model_id").alias("_key")).join(per_key, "_key")
    sure = hits.groupBy("model_id").agg(*numbers).filter(F.col("_lo") == F.col("_hi"))
    return sure.join(entries, sure["_lo"] == entries["entry_no"]).select("model_id", "id", "name", *_TEXT_PRICES)


_TEXT_PRICES = ("prompt", "completion", "cache_read", "cache_write")


def _usable(matched: DataFrame) -> DataFrame:
    """Matches with readable input and output prices, as numbers."""
    return matched.select(
        "model_id",
        "name",
        per_million(F.col("prompt")).alias("_in"),
        per_million(F.col("completion")).alias("_out"),
        per_million(F.col("cache_read")).alias("_read"),
        per_million(F.col("cache_write")).alias("_write"),
    ).filter(F.col("_in").isNotNull() & F.col("_out").isNotNull())


def updated_prices(prices: DataFrame, catalog: DataFrame, fetched_at: int) -> DataFrame:
    """Rows of the price table the catalog changes; missing cache prices stay local."""
    live = _usable(match_catalog(prices.select("model_id"), catalog)).drop("name")
    zero = F.lit(0)
    return prices.join(live, "model_id").select(
        "model_id",
        "display_name",
        F.col("_in").alias(PRICE_COLUMNS[0]),
        F.col("_out").alias(PRICE_COLUMNS[1]),
        F.coalesce("_read", PRICE_COLUMNS[2], zero).alias(PRICE_COLUMNS[2]),
        F.coalesce("_write", PRICE_COLUMNS[3], zero).alias(PRICE_COLUMNS[3]),
        F.lit(PRICE_SOURCE_LIVE).alias("price_source"),
        F.lit(fetched_at).cast("bigint").alias("price_fetched_at"),
    )


def models_in_use(usage: DataFrame) -> DataFrame:
    return usage.filter(F.trim("model") != "").select(F.col("model").alias("model_id")).distinct()


def added_prices(usage: DataFrame, prices: DataFrame, catalog: DataFrame, fetched_at: int) -> DataFrame:
    """Price rows for used models that no existing row names."""
    # the names alone, written once: each use of them would go through the usage rows again
    used = staged(models_in_use(usage), "models-in-use")
    known_keys = prices.select(_keys("model_id").alias("_key")).distinct()
    known = used.select("model_id", _keys("model_id").alias("_key")).join(known_keys, "_key", "left_semi")
    wanted = used.join(known.select("model_id"), "model_id", "left_anti")
    zero = F.lit(0)
    return _usable(match_catalog(wanted, catalog)).select(
        "model_id",
        F.when(F.trim("name") != "", F.col("name")).otherwise(F.col("model_id")).alias("display_name"),
        F.col("_in").alias(PRICE_COLUMNS[0]),
        F.col("_out").alias(PRICE_COLUMNS[1]),
        F.coalesce("_read", zero).alias(PRICE_COLUMNS[2]),
        F.coalesce("_write", zero).alias(PRICE_COLUMNS[3]),
        F.lit(PRICE_SOURCE_LIVE).alias("price_source"),
        F.lit(fetched_at).cast("bigint").alias("price_fetched_at"),
    )


def refreshed_prices(usage: DataFrame, prices: DataFrame, catalog: DataFrame, fetched_at: int) -> DataFrame:
    """The price table after a catalog refresh.

    The changes are staged on their own: the upsert reads them twice, and in its plan the matching of all of them would
    hold its memory beside the upsert's in the same tasks.
    """
    changed = staged(updated_prices(prices, catalog, fetched_at), "changed-prices")
    added = staged(added_prices(usage, prices, catalog, fetched_at), "added-prices")
    out = upsert(prices, changed.unionByName(added), ["model_id"])
    return out.select(*[F.col(f.name).cast(f.dataType) for f in PRICING_SCHEMA])


def refresh_status(
    usage: DataFrame, prices: DataFrame, catalog: DataFrame, fetched_at: int, source: str = PRICE_SOURCE_LIVE
) -> DataFrame:
    """The one-row status of a refresh."""
    parts = {
        "catalog_models": catalog,
        "updated_models": updated_prices(prices, catalog, fetched_at),
        "added_models": added_prices(usage, prices, catalog, fetched_at),
    }
    sizes = None
    for name, df in parts.items():
        size = df.agg(F.count("*").alias("n")).withColumn("part", F.lit(name))
        sizes = size if sizes is None else sizes.unionByName(size)
    row = sizes.agg(*[F.sum(F.when(F.col("part") == n, F.col("n"))).alias(n) for n in parts])
    return row.select(
        F.lit(source).alias("source"),
        F.lit(fetched_at).cast("bigint").alias("fetched_at"),
        *parts,
        (F.col("updated_models") + F.col("added_models")).alias("matched_models"),
    )
