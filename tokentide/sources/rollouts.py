"""Token counters from rollout logs (JSON lines, one thread per file)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import logs as J
from ..functions.names import UUID_PATTERN, request_key, thread_id, thread_model
from ..functions.times import rfc3339, rfc3339_seconds
from ..functions.tokens import clamp, saturating_minus, zero
from ..operators.ordered import CHUNK_ROWS, running, wide_groups
from ..schema import SEMANTICS_LEGACY, SOURCE_CODEX

_USAGE = """struct<input_tokens:bigint,cached_input_tokens:variant,cache_read_input_tokens:bigint,
output_tokens:bigint,reasoning_output_tokens:bigint,total_tokens:bigint>"""
_LINE = f"""type string, timestamp string, payload struct<type:string,id:variant,thread_id:variant,threadId:variant,
forked_from_id:variant,source:struct<subagent:struct<thread_spawn:struct<parent_thread_id:variant>>>,model:variant,
info:struct<model:variant,model_name:variant,total_token_usage:{_USAGE},last_token_usage:{_USAGE}>>"""


def _counters(usage: Column) -> Column:
    """The five counters of a usage object.

    Cached tokens come from the first of two keys that is present, even if its
    value is no number.
    """
    first = usage["cached_input_tokens"]
    cached = F.when(first.isNotNull(), J.integer(first)).otherwise(usage["cache_read_input_tokens"])
    return F.when(
        usage.isNotNull(),
        F.struct(
            J.count(usage["input_tokens"]).alias("input"),
            J.count(cached).alias("cached"),
            J.count(usage["output_tokens"]).alias("output"),
            J.count(usage["reasoning_output_tokens"]).alias("reasoning"),
            J.count(usage["total_tokens"]).alias("total"),
        ),
    )


def _signature(counters: str) -> Column:
    names = ("input", "cached", "output", "reasoning", "total")
    values = [F.coalesce(F.col(f"{counters}.{n}").cast("string"), F.lit("-")) for n in names]
    return F.when(F.col(counters).isNotNull(), F.concat_ws(",", *values)).otherwise(F.lit("none"))


def _clean(v: Column) -> Column:
    return F.nullif(F.trim(J.text(v)), F.lit(""))


def rollout_records(lines: DataFrame) -> DataFrame:
    """One narrow row per line of (file_path, file_name, line_no, value) that is JSON.

    kind: meta, model, token or other; ``other`` rows only carry the time, which
    tells how far a parent log has been written.
    """
    j, value = F.col("j"), F.col("value")
    has_event = value.contains('"event_msg"')
    tagged = has_event | value.contains('"turn_context"') | value.contains('"session_meta"')
    own = tagged & (~has_event | value.contains('"token_count"'))
    marked = lines.select("file_path", "file_name", "line_no", "value", own.alias("own"))
    logged = J.parsed(marked, "value", _LINE, "file_path", "file_name", "line_no", "own", "value")

    payload, info = j["payload"], j["payload"]["info"]
    total, last = info["total_token_usage"], info["last_token_usage"]
    is_count = (j["type"] == "event_msg") & (payload["type"] == "token_count")
    is_meta = F.col("own") & (j["type"] == "session_meta")
    is_context = F.col("own") & (j["type"] == "turn_context")
    # A total that is present but no object still counts as present.
    info_keys = F.json_object_keys(F.get_json_object("value", "$.payload.info"))
    names_total = F.coalesce(F.array_contains(info_keys, "total_token_usage"), F.lit(False))
    place = ["file_path", "file_name", "line_no"]
    # Several steps: the code generated for one has to stay within what the JVM compiles (8000 bytes a method).
    told = J.computed(
        logged,
        [*place, "j"],
        {
            "is_meta": F.coalesce(is_meta, F.lit(False)),
            "is_context": F.coalesce(is_context, F.lit(False)),
            "has_total": F.when(total.isNotNull(), True).when(is_count & last.isNotNull(), names_total).otherwise(False),
            "of_total": F.when(is_count, _counters(total)),
        },
    )
    counters = J.computed(told, [*place, "j", "is_meta", "is_context", "has_total", "of_total"], {"of_last": F.when(is_count, _counters(last))})
    read = J.computed(
        counters,
        [*place, "is_meta", "is_context", "has_total", "of_total", "of_last"],
        {
            "at": j["timestamp"],
            "named": F.when(
                F.col("is_context"),
                J.text(F.coalesce(payload["model"], info["model"])),
            ).when(is_count, J.text(F.coalesce(info["model"], info["model_name"], payload["model"]))),
            "meta": F.when(
                F.col("is_meta"),
                F.struct(
                    _clean(F.coalesce(payload["id"], payload["thread_id"], payload["threadId"])).alias("id"),
                    _clean(payload["forked_from_id"]).alias("forked_from"),
                    _clean(payload["source"]["subagent"]["thread_spawn"]["parent_thread_id"]).alias("spawned_by"),
                ),
            ),
        },
    )
    is_token = F.col("of_total").isNotNull() | F.col("of_last").isNotNull()
    kind = (
        F.when(F.col("is_meta"), "meta")
        .when(F.col("is_context"), "model")
        .when(is_token, "token")
        .otherwise("other")
    )
    used = F.when(F.col("has_total"), F.col("of_total")).otherwise(F.col("of_last"))
    columns = {
        "kind": kind,
        "model": thread_model(F.col("named")),
        "signature": F.when(is_token, F.concat_ws("|", _signature("of_total"), _signature("of_last"))),
        "used": used,
        "ts": rfc3339(F.col("at")),
    }
    rows = J.computed(read, [*place, "at", "has_total", "meta"], columns)
    counted = F.col("used").isNotNull()

    def used_count(name: str) -> Column:
        return F.when(counted, F.coalesce(F.col(f"used.{name}"), zero())).alias(name)

    return rows.select(
        "file_path",
        thread_id(F.col("file_name")).alias("thread_id"),
        "line_no",
        "kind",
        "at",
        F.when(F.col("kind").isin("model", "token"), F.col("model")).alias("model"),
        "signature",
        counted.alias("counted"),
        (counted & F.col("has_total")).alias("is_total"),
        used_count("input"),
        used_count("cached"),
        used_count("output"),
        "meta",
        "ts",
    )


def rollout_index(files: DataFrame) -> DataFrame:
    """Thread id to its files, from (file_path, file_name)."""
    named = files.select(thread_id(F.col("file_name")).alias("thread_id"), "file_path")
    return named.filter("thread_id is not null").groupBy("thread_id").agg(
        F.array_sort(F.collect_set("file_path")).alias("paths")
    )


def hyphenated(text: Column) -> Column:
    """A thread id written without hyphens gets them; any other text stays as it is."""
    return F.regexp_replace(text, r"^([0-9a-fA-F]{8})([0-9a-fA-F]{4})([0-9a-fA-F]{4})([0-9a-fA-F]{4})([0-9a-fA-F]{12})$", "$1-$2-$3-$4-$5")


def classify_threads(records: DataFrame) -> DataFrame:
    """Per file: (thread_id, fork_ts, parent_status, parent_id, reason).

    Status none, parent or deferred comes from the first meta record, NULL when
    there is none. A thread is deferred when its ids disagree, or its parent is
    no thread id or itself.
    """
    meta_line = F.when(F.col("kind") == "meta", F.col("line_no"))
    first = records.groupBy("file_path").agg(
        F.max("thread_id").alias("thread_id"),
        F.min_by(F.struct("meta", "ts"), meta_line).alias("f"),
    )
    own = F.col("thread_id")
    named, forked, spawned = (hyphenated(F.col(f"f.meta.{c}")) for c in ("id", "forked_from", "spawned_by"))
    given = F.coalesce(forked, spawned)
    reason = (
        F.when((own != named), "thread id differs from file name")
        .when(forked != spawned, "parents disagree")
        .when(given.isNotNull() & ~given.rlike(f"^{UUID_PATTERN}$"), "parent is not a thread id")
        .when(F.lower(given) == own, "parent is the thread itself")
    )
    status = F.when(
        F.col("f").isNotNull(),
        F.when(reason.isNotNull(), "deferred").when(given.isNotNull(), "parent").otherwise("none"),
    )
    return first.select(
        "file_path",
        own.alias("thread_id"),
        F.col("f.ts").alias("fork_ts"),
        status.alias("parent_status"),
        F.when(status == "parent", F.lower(given)).alias("parent_id"),
        reason.alias("reason"),
    )


def token_events(records: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Counted events with model, delta, index of the delta and position in the file.

    Counters are cumulative: the delta is taken against the latest total event.
    Events that only report the last request count as they are and leave the
    total untouched. The index numbers non-zero deltas, the position all events.
    """
    own = records.filter("kind in ('model', 'token')")
    wide = wide_groups(own, "file_path", "line_no", chunk_rows)
    total = F.when(F.col("counted") & F.col("is_total"), F.struct("input", "cached", "output"))
    filled = running(
        own,
        ["file_path"],
        "line_no",
        last={"_model": F.col("model")},
        last_before={"_prev": total},
        chunk_rows=chunk_rows,
        wide=wide,
    )

    def step(name: str) -> Column:
        since = F.when(F.col("is_total"), saturating_minus(F.col(name), F.col(f"_prev.{name}")))
        return clamp(F.coalesce(since, F.col(name)))

    deltas = filled.filter("counted").select(
        "file_path",
        "thread_id",
        "line_no",
        "at",
        "ts",
        "signature",
        F.coalesce("_model", F.lit("unknown")).alias("model"),
        step("input").alias("input_tokens"),
        F.least(step("cached"), step("input")).alias("cache_read_tokens"),
        step("output").alias("output_tokens"),
    )
    billable = F.greatest("input_tokens", "cache_read_tokens", "output_tokens") > 0
    numbered = running(
        deltas,
        ["file_path"],
        "line_no",
        count={"event_index": billable, "position": F.lit(True)},
        chunk_rows=chunk_rows,
        wide=wide,
    )
    return numbered.withColumn("event_index", F.when(billable, F.col("event_index")))


def rollout_usage(events: DataFrame, ingest_ts: int) -> DataFrame:
    """Usage rows of the non-zero events."""
    return events.filter("event_index is not null").select(
        "file_path",
        "line_no",
        request_key("codex_session", F.lit("thread-v1"), F.col("thread_id"), F.col("event_index")).alias("request_id"),
        F.lit("_codex_session").alias("provider_id"),
        F.lit("codex").alias("app_type"),
        "model",
        F.col("model").alias("request_model"),
        "input_tokens",
        "output_tokens",
        "cache_read_tokens",
        F.lit(0).cast("bigint").alias("cache_creation_tokens"),
        F.lit(SEMANTICS_LEGACY).alias("input_token_semantics"),
        F.col("thread_id").alias("session_id"),
        F.lit(SOURCE_CODEX).alias("provider_type"),
        F.coalesce(rfc3339_seconds(F.col("at")), F.lit(ingest_ts).cast("bigint")).alias("created_at"),
        F.lit(SOURCE_CODEX).alias("data_source"),
    )
