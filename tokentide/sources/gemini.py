"""Model turns from chat files (one JSON document per file)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import logs as J
from ..functions.names import request_key
from ..functions.times import rfc3339_seconds
from ..functions.tokens import clamp
from ..schema import SEMANTICS_LEGACY, SOURCE_GEMINI

_CHAT = """sessionId variant, messages array<struct<id:variant,type:string,model:variant,timestamp:string,
tokens:struct<input:bigint,output:bigint,cached:bigint,thoughts:bigint>>>"""
_COUNTS = ("input", "output", "cached", "thoughts")


def gemini_usage(documents: DataFrame, ingest_ts: int) -> DataFrame:
    """Usage rows from (file_path, value)."""
    j, m = F.col("j"), F.col("m")
    messages = (
        J.parsed(documents, "value", _CHAT, "file_path")
        .select("file_path", j["sessionId"].alias("session"), F.posexplode(j["messages"]).alias("line_no", "m"))
        .filter((m["type"] == "gemini") & m["tokens"].isNotNull())
    )
    unknown = F.lit("unknown")
    rows = J.computed(
        messages.filter(F.greatest(*[J.count_or_zero(m["tokens"][n]) for n in _COUNTS]) > 0),
        ["file_path", "line_no"],
        {
            "session_id": J.text(F.col("session")),
            "message_id": F.coalesce(J.text(m["id"]), unknown),
            "model": F.coalesce(J.text(m["model"]), unknown),
            "at": m["timestamp"],
            **{f"_{n}": J.count_or_zero(m["tokens"][n]) for n in _COUNTS},
        },
    )
    return rows.select(
        "file_path",
        F.col("line_no").cast("bigint").alias("line_no"),
        request_key("gemini_session", F.coalesce("session_id", unknown), F.col("message_id")).alias("request_id"),
        F.lit("_gemini_session").alias("provider_id"),
        F.lit("gemini").alias("app_type"),
        "model",
        F.col("model").alias("request_model"),
        F.col("_input").alias("input_tokens"),
        clamp(F.col("_output") + F.col("_thoughts")).alias("output_tokens"),
        F.col("_cached").alias("cache_read_tokens"),
        F.lit(0).cast("bigint").alias("cache_creation_tokens"),
        F.lit(SEMANTICS_LEGACY).alias("input_token_semantics"),
        "session_id",
        F.lit(SOURCE_GEMINI).alias("provider_type"),
        F.coalesce(rfc3339_seconds(F.col("at")), F.lit(ingest_ts).cast("bigint")).alias("created_at"),
        F.lit(SOURCE_GEMINI).alias("data_source"),
    )
