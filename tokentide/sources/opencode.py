"""Assistant messages from a message table with a JSON payload."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import logs as J
from ..functions.names import request_key
from ..functions.times import millis_to_seconds
from ..functions.tokens import clamp
from ..schema import MONEY, SEMANTICS_LEGACY, SOURCE_OPENCODE

_PAYLOAD = """role string, modelID variant, cost double, tokens struct<input:bigint,output:bigint,reasoning:bigint,
cache:struct<read:bigint,write:bigint>>, time struct<created:bigint,completed:variant>"""


def _assistant(messages: DataFrame, *keep: str) -> DataFrame:
    j = F.col("j")
    return J.parsed(messages, "data", _PAYLOAD, *keep).filter((j["role"] == "assistant") & j["tokens"].isNotNull())


def opencode_incomplete(messages: DataFrame) -> DataFrame:
    """Sessions with a message still being written: (session_id, incomplete)."""
    open_ones = _assistant(messages, "session_id").filter(F.col("j")["time"]["completed"].isNull())
    return open_ones.groupBy("session_id").agg(F.count("*").alias("incomplete"))


def opencode_usage(messages: DataFrame, ingest_ts: int) -> DataFrame:
    """Usage rows from (id, session_id, time_created, data); a reported cost replaces pricing."""
    j = F.col("j")
    tokens = j["tokens"]
    counts = {
        "_input": tokens["input"],
        "_output": tokens["output"],
        "_reasoning": tokens["reasoning"],
        "_read": tokens["cache"]["read"],
        "_write": tokens["cache"]["write"],
    }
    done = _assistant(messages, "id", "session_id", "time_created").filter(j["time"]["completed"].isNotNull())
    rows = J.computed(
        done.filter(F.greatest(*[J.count_or_zero(c) for c in counts.values()]) > 0),
        ["id", "session_id", "time_created"],
        {
            "model": F.coalesce(J.text(j["modelID"]), F.lit("unknown")),
            "cost": j["cost"],
            "created_ms": F.coalesce(j["time"]["created"], F.lit(0)),
            **{n: J.count_or_zero(c) for n, c in counts.items()},
        },
    )
    return rows.select(
        F.col("session_id").alias("file_path"),
        F.col("time_created").alias("line_no"),
        request_key("opencode_session", F.col("session_id"), F.col("id")).alias("request_id"),
        F.lit("_opencode_session").alias("provider_id"),
        F.lit("opencode").alias("app_type"),
        "model",
        F.col("model").alias("request_model"),
        F.col("_input").alias("input_tokens"),
        clamp(F.col("_output") + F.col("_reasoning")).alias("output_tokens"),
        F.col("_read").alias("cache_read_tokens"),
        F.col("_write").alias("cache_creation_tokens"),
        F.lit(SEMANTICS_LEGACY).alias("input_token_semantics"),
        "session_id",
        F.lit(SOURCE_OPENCODE).alias("provider_type"),
        millis_to_seconds(F.col("created_ms"), ingest_ts).alias("created_at"),
        F.lit(SOURCE_OPENCODE).alias("data_source"),
        F.when(F.col("cost") > 0, F.col("cost").try_cast(MONEY)).alias("reported_cost"),
        F.lit("all").alias("reported_replaces"),
        F.lit(False).alias("reported_partial"),
    )
