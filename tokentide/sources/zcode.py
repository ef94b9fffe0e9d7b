"""Rows of a typed model-usage table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.names import request_key
from ..functions.times import millis_to_seconds
from ..functions.tokens import clamp
from ..schema import SEMANTICS_TOTAL, SOURCE_ZCODE

_COUNTS = (
    "input_tokens",
    "output_tokens",
    "reasoning_tokens",
    "cache_creation_input_tokens",
    "cache_read_input_tokens",
)


def zcode_incomplete(usages: DataFrame) -> DataFrame:
    """Sessions with a request still running: (session_id, incomplete)."""
    return usages.filter("completed_at is null").groupBy("session_id").agg(F.count("*").alias("incomplete"))


def zcode_usage(usages: DataFrame, ingest_ts: int) -> DataFrame:
    counts = {f"_{c}": clamp(F.coalesce(F.col(c), F.lit(0))) for c in _COUNTS}
    rows = usages.filter("completed_at is not null").withColumns(counts).filter(F.greatest(*counts) > 0)
    given = F.col("model_id")
    model = F.when(F.trim(given) != "", given).otherwise(F.lit("unknown"))
    begun = F.coalesce("started_at", "completed_at")
    return rows.select(
        F.col("session_id").alias("file_path"),
        F.coalesce("started_at", "completed_at", F.lit(0)).alias("line_no"),
        request_key("zcode_session", F.col("id")).alias("request_id"),
        F.lit("_zcode_session").alias("provider_id"),
        F.lit("zcode").alias("app_type"),
        model.alias("model"),
        model.alias("request_model"),
        F.col("_input_tokens").alias("input_tokens"),
        (F.col("_output_tokens") + F.col("_reasoning_tokens")).alias("output_tokens"),
        F.col("_cache_read_input_tokens").alias("cache_read_tokens"),
        F.col("_cache_creation_input_tokens").alias("cache_creation_tokens"),
        F.lit(SEMANTICS_TOTAL).alias("input_token_semantics"),
        F.greatest(F.coalesce("duration_ms", F.lit(0)), F.lit(0)).alias("latency_ms"),
        F.when(F.col("time_to_first_token_ms") < 0, 0)
        .otherwise(F.col("time_to_first_token_ms"))
        .alias("first_token_ms"),
        "session_id",
        F.lit(SOURCE_ZCODE).alias("provider_type"),
        millis_to_seconds(begun, ingest_ts).alias("created_at"),
        F.lit(SOURCE_ZCODE).alias("data_source"),
    )
