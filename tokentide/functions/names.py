"""Model, provider and request naming."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schema import PROVIDER_NAMES

# Fixed pattern: a thread id is a hyphenated UUID.
UUID_PATTERN = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"


def provider_name(provider: Column | None = None) -> Column:
    provider = F.col("provider_id") if provider is None else provider
    names = F.create_map(*[F.lit(x) for pair in PROVIDER_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, provider), provider)


def effective_model() -> Column:
    return F.coalesce(F.nullif(F.col("pricing_model"), F.lit("")), F.col("model"))


def strip_day(model: Column) -> Column:
    """Drop a trailing -YYYYMMDD."""
    return F.regexp_replace(model, "-[0-9]{8}$", "")


def thread_model(model: Column) -> Column:
    """Model name as written in rollout logs: lower case, last path part, no date."""
    last = F.substring_index(F.lower(model), "/", -1)
    no_day = F.regexp_replace(last, "(?<=.)-[0-9]{4}-[0-9]{2}-[0-9]{2}$", "")
    return F.regexp_replace(no_day, "(?<=.)-[0-9]{8}$", "")


def catalog_key(model: Column) -> Column:
    """Model name as compared with a price catalog."""
    base = F.substring_index(F.substring_index(model, "/", -1), ":", 1)
    return F.translate(F.lower(F.trim(base)), "_.", "--")


def request_key(prefix: str, *parts: Column) -> Column:
    return F.concat_ws(":", F.lit(prefix), *parts)


def thread_id(file_name: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(file_name, f"({UUID_PATTERN})\\.jsonl$", 1), F.lit("")))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)
