"""Turn-completed updates (JSON lines), one usage row per model of a turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import logs as J
from ..functions.money import ticks
from ..functions.names import request_key
from ..functions.times import mixed_epoch
from ..functions.tokens import clamp
from ..operators.ordered import CHUNK_ROWS, running, wide_groups
from ..schema import SEMANTICS_TOTAL, SETTLE_WINDOW_SECONDS, SOURCE_GROK
from ..session import staged

_METHOD = "_x.ai/session/update"  # fixed value
_COUNTERS = """inputTokens:bigint,outputTokens:bigint,cachedReadTokens:bigint,apiDurationMs:bigint,
costUsdTicks:bigint,costIsPartial:boolean"""
_LINE = f"""method string, timestamp variant, params struct<update:struct<sessionUpdate:variant,prompt_id:variant,
usage:struct<{_COUNTERS},modelUsage:map<string,struct<{_COUNTERS}>>>>>"""


def grok_events(lines: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Parsed turns with their position in the file."""
    j = F.col("j")
    update = j["params"]["update"]
    usable = F.col("value").contains("session") & F.col("value").contains("usage")
    updates = J.parsed(lines.filter(usable), "value", _LINE, "file_path", "line_no").filter(
        (j["method"] == _METHOD) & update["usage"].isNotNull()
    )
    events = J.computed(
        updates,
        ["file_path", "line_no"],
        {
            "kind": J.text(update["sessionUpdate"]),
            "created_at": mixed_epoch(J.integer(j["timestamp"]), J.text(j["timestamp"])),
            "prompt_id": F.coalesce(J.text(update["prompt_id"]), F.lit("")),
            "usage": update["usage"],
        },
    )
    timed = events.filter(
        (F.col("kind").isNull() | (F.col("kind") == "turn_completed")) & F.col("created_at").isNotNull()
    ).drop("kind")
    # Numbering reads its input twice; the logs are parsed once.
    turns = staged(timed, "turns")
    wide = wide_groups(turns, "file_path", "line_no", chunk_rows)
    placed = running(turns, ["file_path"], "line_no", count={"_n": F.lit(True)}, chunk_rows=chunk_rows, wide=wide)
    return placed.withColumn("event_no", F.col("_n") - 1).drop("_n")


def settled_events(events: DataFrame, as_of: int, window: int = SETTLE_WINDOW_SECONDS) -> DataFrame:
    """Events before the first one of their file that is younger than the window."""
    young = F.lit(as_of) - F.col("created_at") < window
    barrier = events.filter(young).groupBy("file_path").agg(F.min("event_no").alias("_barrier"))
    return (
        events.join(barrier, "file_path", "left")
        .filter(F.col("_barrier").isNull() | (F.col("event_no") < F.col("_barrier")))
        .drop("_barrier")
    )


def deferred_files(events: DataFrame, as_of: int, window: int = SETTLE_WINDOW_SECONDS) -> DataFrame:
    return events.filter(F.lit(as_of) - F.col("created_at") < window).select("file_path").distinct()


def grok_usage(events: DataFrame) -> DataFrame:
    """Usage rows of (settled) events; the session is the folder of the file."""
    usage, c = F.col("usage"), F.col("c")
    names = ("inputTokens", "outputTokens", "cachedReadTokens", "apiDurationMs", "costUsdTicks", "costIsPartial")
    whole = F.create_map(F.lit("unknown"), F.struct(*[usage[n].alias(n) for n in names]))
    per_model = F.when(F.size(usage["modelUsage"]) > 0, usage["modelUsage"]).otherwise(whole)
    rows = events.select(
        "file_path",
        "event_no",
        "created_at",
        "prompt_id",
        F.coalesce(usage["costIsPartial"], F.lit(False)).alias("_partial"),
        F.explode(per_model).alias("model", "c"),
    ).select(
        "*",
        J.count_or_zero(c["inputTokens"]).alias("_input"),
        J.count_or_zero(c["outputTokens"]).alias("_output"),
        J.count_or_zero(c["cachedReadTokens"]).alias("_cached"),
    )
    rows = rows.filter(F.greatest("_input", "_output", "_cached") > 0)
    folder = F.element_at(F.split("file_path", "/"), -2)
    turn = F.when(F.col("prompt_id") == "", F.concat(F.lit("idx"), F.col("event_no"))).otherwise(F.col("prompt_id"))
    return rows.select(
        "file_path",
        F.col("event_no").alias("line_no"),
        request_key("grok_session", folder, turn, F.col("model")).alias("request_id"),
        F.lit("_grok_session").alias("provider_id"),
        F.lit("grokbuild").alias("app_type"),
        "model",
        F.col("model").alias("request_model"),
        clamp(F.col("_input")).alias("input_tokens"),
        clamp(F.col("_output")).alias("output_tokens"),
        clamp(F.col("_cached")).alias("cache_read_tokens"),
        F.lit(0).cast("bigint").alias("cache_creation_tokens"),
        F.lit(SEMANTICS_TOTAL).alias("input_token_semantics"),
        J.count_or_zero(c["apiDurationMs"]).alias("latency_ms"),
        folder.alias("session_id"),
        F.lit(SOURCE_GROK).alias("provider_type"),
        "created_at",
        F.lit(SOURCE_GROK).alias("data_source"),
        ticks(J.count(c["costUsdTicks"])).alias("reported_cost"),
        F.lit("total").alias("reported_replaces"),
        (F.col("_partial") | F.coalesce(c["costIsPartial"], F.lit(False))).alias("reported_partial"),
    )
