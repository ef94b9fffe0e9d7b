"""Assistant turns from project logs (JSON lines)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import logs as J
from ..functions.names import request_key
from ..functions.times import rfc3339_seconds
from ..functions.tokens import is_billable
from ..operators.merge import best_per_key
from ..schema import SOURCE_CLAUDE

_LINE = """type string, sessionId variant, timestamp string, message struct<id:variant,model:variant,
stop_reason:variant,usage:struct<input_tokens:bigint,output_tokens:bigint,cache_read_input_tokens:bigint,
cache_creation_input_tokens:bigint>>"""


def claude_usage(lines: DataFrame, ingest_ts: int) -> DataFrame:
    """Usage rows from (file_path, line_no, value).

    A message is logged several times while it streams; per file the finished
    version wins, then the one with more output, then the earliest. Its session
    is the first session id of the file, if that came no later than the row.
    """
    j = F.col("j")
    place = ("file_path", "line_no")

    named = J.parsed(lines.filter(F.col("value").contains("sessionId")), "value", "sessionId variant", *place)
    sessions = (
        J.computed(named, list(place), {"session": J.text(j["sessionId"])})
        .filter("session is not null")
        .groupBy("file_path")
        .agg(F.min_by("session", "line_no").alias("_session"), F.min("line_no").alias("_since"))
    )

    logged = J.parsed(lines.filter(F.col("value").contains("assistant")), "value", _LINE, *place)
    message, usage = j["message"], j["message"]["usage"]
    turns = J.computed(
        logged.filter((j["type"] == "assistant") & usage.isNotNull()),
        list(place),
        {
            "message_id": J.text(message["id"]),
            "model": F.coalesce(J.text(message["model"]), F.lit("unknown")),
            "input_tokens": J.count_or_zero(usage["input_tokens"]),
            "output_tokens": J.count_or_zero(usage["output_tokens"]),
            "cache_read_tokens": J.count_or_zero(usage["cache_read_input_tokens"]),
            "cache_creation_tokens": J.count_or_zero(usage["cache_creation_input_tokens"]),
            "finished": J.text(message["stop_reason"]).isNotNull(),
            "at": j["timestamp"],
        },
    ).filter("message_id is not null")
    best = best_per_key(
        turns,
        ["file_path", "message_id"],
        F.col("finished"),
        F.col("output_tokens"),
        -F.col("line_no"),
    )
    rows = best.filter(is_billable()).join(sessions, "file_path", "left")
    return rows.select(
        "file_path",
        "line_no",
        request_key("session", F.col("message_id")).alias("request_id"),
        F.lit("_session").alias("provider_id"),
        F.lit("claude").alias("app_type"),
        "model",
        F.col("model").alias("request_model"),
        "input_tokens",
        "output_tokens",
        "cache_read_tokens",
        "cache_creation_tokens",
        F.when(F.col("_since") <= F.col("line_no"), F.col("_session")).alias("session_id"),
        F.lit(SOURCE_CLAUDE).alias("provider_type"),
        F.coalesce(rfc3339_seconds(F.col("at")), F.lit(ingest_ts).cast("bigint")).alias("created_at"),
        F.lit(SOURCE_CLAUDE).alias("data_source"),
    )
