"""Raw logs of every source written from the events table, and their ingestion.

Each event becomes one or two raw records of a tool's own format; the adapters
read them back and the SQL states the expected rows without any JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tokentide.functions.logs import computed
from tokentide.operators import cursors as C
from tokentide.operators.dedup import drop_near_activity, ingest_dedup
from tokentide.operators.merge import (
    forget_cursors,
    forget_sessions,
    merge_counts,
    new_rows,
    stamp_device,
    upsert,
)
from tokentide.operators.replay import parent_timeline, replay_prefix
from tokentide.operators.transfer import export_usage, import_summary, import_usage, read_documents, read_export, to_records
from tokentide.plans.ingest import ingest_all, rollout_rows, rollout_tables
from tokentide.plans.sync import sync_claude, sync_files
from tokentide.schema import CURSOR_SCHEMA, SESSION_SOURCES, TRANSFER_VERSION
from tokentide.session import new_path, staged
from tokentide.operators.pricing import seed_prices
from tokentide.sources.claude import claude_usage
from tokentide.sources.gemini import gemini_usage
from tokentide.sources.lines import list_files, read_files, write_logs
from tokentide.sources.grok import deferred_files, grok_events, grok_usage, settled_events
from tokentide.sources.opencode import opencode_incomplete, opencode_usage
from tokentide.sources.rollouts import rollout_index, rollout_records, rollout_usage, token_events
from tokentide.sources.zcode import zcode_incomplete, zcode_usage

from .views import (
    EVENTS_SQL,
    MATCH_BY_APP,
    MODELS,
    T0,
    WITH_USAGE,
    big,
    events,
    money,
    pick,
    spread,
    sql_case,
    sql_cost,
    usage,
)

NOW = T0 + 90 * 86400
FORK = T0 + 14 * 86400
SETTLED_AT = T0 + 28 * 86400

ROW = (
    "request_id",
    "app_type",
    "model",
    "input_tokens",
    "output_tokens",
    "cache_read_tokens",
    "cache_creation_tokens",
    "session_id",
    "created_at",
)


def written(df, **columns):
    """Raw records; their text is made once, whatever later reads of it filter on."""
    return computed(df, [], columns)


def iso(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def model_of(e) -> Column:
    return pick(MODELS, F.col("user_id") % 6)


def tokens_in() -> Column:
    return F.floor(F.col("value") * 100).cast("bigint")


def wild(count: Column) -> Column:
    """Some records report a count far beyond what a counter can hold."""
    return F.when(F.col("k") == 7, F.lit(5_000_000_000_000)).otherwise(count)


# --- project logs ----------------------------------------------------------------


def claude_lines(spark, sf):
    """Two lines per event: a draft and the final version; views are user lines."""
    return claude_lines_of(events(spark, sf))


def claude_lines_of(rows):
    e = rows.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("x"))
    final = F.col("x") == 1
    kind = F.when(F.col("event_type") == "view", "user").otherwise("assistant")
    message = F.struct(
        F.concat(F.lit("m"), "event_id").alias("id"),
        F.when(F.col("user_id") % 6 != 4, model_of(e)).alias("model"),
        F.when(final & (F.col("event_type") != "error"), "end_turn").alias("stop_reason"),
        F.struct(
            wild(tokens_in()).alias("input_tokens"),
            F.when(final, F.col("k") * 11).otherwise(F.col("k") * 20).alias("output_tokens"),
            (F.col("k") * 50).alias("cache_read_input_tokens"),
            F.when(F.col("k") > 50, F.col("k")).alias("cache_creation_input_tokens"),
        ).alias("usage"),
    )
    line = F.struct(
        kind.alias("type"),
        F.when(F.col("event_type") == "click", F.concat(F.lit("s-"), "user_id")).alias("sessionId"),
        F.when(F.col("event_type") != "signup", iso(F.col("t"))).alias("timestamp"),
        message.alias("message"),
    )
    return written(
        e,
        file_path=F.concat(F.lit("/home/projects/p/s-"), "user_id", F.lit(".jsonl")),
        line_no=F.col("event_id") * 2 + F.col("x"),
        value=F.concat(F.to_json(line), F.when(F.col("event_type") == "purchase", "  ").otherwise("")),
    )


def ingest_claude(spark, sf):
    return claude_usage(claude_lines(spark, sf), NOW).select(*ROW)


WAVE = T0 + 15 * 86400


def sync_claude_files(spark, sf):
    """Project logs as real files in two waves; each pass opens only the files that are new."""
    e = events(spark, sf)
    folder = new_path(spark, "projects")
    cursors = spark.createDataFrame([], CURSOR_SCHEMA)
    out = None
    for wave, part in enumerate((F.col("t") < WAVE, F.col("t") >= WAVE)):
        # events are told apart before their text is made
        own = claude_lines_of(e.join(e.filter(part).select(F.col("event_id").alias("event")), F.col("event_id") == F.col("event"), "left_semi"))
        write_logs(own.withColumn("user", F.regexp_extract("file_path", "s-([0-9]+)", 1)), "user", "line_no", folder)
        done = sync_files(spark, list_files(spark, folder, glob="*.txt"), cursors, read_files, sync_claude, NOW, by_table=True)
        rows, changes = (staged(df, "sync") for df in done)
        cursors = staged(upsert(cursors, changes, ["file_path"]), "cursors")
        rows = rows.select(F.lit(wave).alias("wave"), *ROW)
        out = rows if out is None else out.unionByName(rows)
    return out


# --- chat documents ----------------------------------------------------------------


def gemini_documents(spark, sf):
    e = events(spark, sf)
    own = F.struct(
        F.when(F.col("event_type") != "error", F.concat(F.lit("g"), "event_id")).alias("id"),
        F.lit("gemini").alias("type"),
        model_of(e).alias("model"),
        iso(F.col("t")).alias("timestamp"),
        F.struct(
            wild(tokens_in()).alias("input"), F.col("k").alias("output"), (F.col("k") * 3).alias("cached"), (F.col("k") * 2).alias("thoughts")
        ).alias("tokens"),
    )
    asked = own.withField("type", F.lit("user"))
    body = F.struct(
        F.when(F.col("event_type") != "signup", F.concat(F.lit("c"), "event_id")).alias("sessionId"),
        F.array(asked, own).alias("messages"),
    )
    return written(
        e, file_path=F.concat(F.lit("/tmp/p/chats/session-"), "event_id", F.lit(".json")), value=F.to_json(body)
    )


def ingest_gemini(spark, sf):
    return gemini_usage(gemini_documents(spark, sf), NOW).select(*ROW)


# --- message table -------------------------------------------------------------------


def opencode_tables(spark, sf):
    e = events(spark, sf)
    sessions = e.groupBy(F.concat(F.lit("s-"), "user_id").alias("id")).agg((F.min("t") * 1000).alias("time_updated"))
    data = F.struct(
        F.when(F.col("event_type") == "view", "user").otherwise("assistant").alias("role"),
        model_of(e).alias("modelID"),
        F.when(F.col("event_type") == "purchase", F.when(F.col("k") == 9, F.lit(4e12)).otherwise(F.round(F.col("value"), 2))).alias("cost"),
        F.struct(
            wild(tokens_in()).alias("input"),
            F.col("k").alias("output"),
            (F.col("k") * 2).alias("reasoning"),
            F.struct((F.col("k") * 5).alias("read"), (F.col("k") * 7).alias("write")).alias("cache"),
        ).alias("tokens"),
        F.struct(
            (F.col("t") * 1000 + 7).alias("created"), F.when(F.col("event_type") != "error", F.col("t") * 1000 + 900).alias("completed")
        ).alias("time"),
    )
    messages = written(
        e,
        id=F.concat(F.lit("m"), "event_id"),
        session_id=F.concat(F.lit("s-"), "user_id"),
        time_created=F.col("t") * 1000,
        time_updated=F.col("t") * 1000 + 900,
        data=F.to_json(data),
    )
    return sessions, messages


def ingest_opencode(spark, sf):
    rows = opencode_usage(opencode_tables(spark, sf)[1], NOW)
    return rows.select(*ROW, F.round("reported_cost", 6).cast("double").alias("reported_cost"))


def opencode_watermarks(spark, sf):
    """Sessions due after a sync that stopped midway, and whether they may advance."""
    sessions, messages = opencode_tables(spark, sf)
    marks = C.message_watermarks(sessions, messages)
    seen = marks.filter(F.col("watermark") < (T0 + 29 * 86400) * 1000)
    old = C.session_cursors(seen, opencode_incomplete(messages).limit(0), "oc", NOW)
    due = C.due_sessions(marks, old, "oc")
    ready = C.session_cursors(due, opencode_incomplete(messages), "oc", NOW).select(
        F.substring_index("file_path", ":", -1).alias("session_id"), F.lit(True).alias("advances")
    )
    return due.join(ready, "session_id", "left").na.fill(False, ["advances"])


# --- typed usage table -----------------------------------------------------------------


def zcode_tables(spark, sf):
    e = events(spark, sf)
    sessions = e.groupBy(F.concat(F.lit("s-"), "user_id").alias("id")).agg(
        (F.min("t") * 1000).alias("time_created"),
        F.max(F.when(F.col("event_type") == "signup", F.col("t") * 1000 + 5000)).alias("time_updated"),
    )
    usages = e.select(
        F.concat(F.lit("z"), "event_id").alias("id"),
        F.concat(F.lit("s-"), "user_id").alias("session_id"),
        F.when(F.col("user_id") % 6 == 4, " ").otherwise(model_of(e)).alias("model_id"),
        F.when(F.col("k") == 7, F.lit(5_000_000_000)).otherwise(tokens_in()).alias("input_tokens"),
        F.when(F.col("k") == 8, F.lit(-5)).otherwise(F.col("k")).cast("bigint").alias("output_tokens"),
        (F.col("k") * 2).alias("reasoning_tokens"),
        (F.col("k") * 3).alias("cache_creation_input_tokens"),
        F.when(F.col("k") > 10, F.col("k") * 4).alias("cache_read_input_tokens"),
        F.when(F.col("event_type") != "click", F.col("t") * 1000 + 123).alias("started_at"),
        F.when(F.col("event_type") != "error", F.col("t") * 1000 + 5000).alias("completed_at"),
        (F.col("k") * 9 - 50).alias("duration_ms"),
        F.when(F.col("k") > 3, F.col("k") - 20).alias("time_to_first_token_ms"),
    )
    return sessions, usages


def ingest_zcode(spark, sf):
    return zcode_usage(zcode_tables(spark, sf)[1], NOW).select(*ROW, "latency_ms", "first_token_ms")


def zcode_watermarks(spark, sf):
    sessions, usages = zcode_tables(spark, sf)
    open_ones = zcode_incomplete(usages)
    return C.usage_watermarks(sessions, usages).join(open_ones, "session_id", "left").na.fill(0, ["incomplete"])


# --- update logs -------------------------------------------------------------------------


def grok_lines(spark, sf):
    e = events(spark, sf)

    def counters(factor: int) -> list[Column]:
        return [
            (tokens_in() * factor).alias("inputTokens"),
            (F.col("k") * factor).alias("outputTokens"),
            (F.col("k") * 2 * factor).alias("cachedReadTokens"),
            (F.col("k") * 100).alias("apiDurationMs"),
            (F.col("k") * 1_000_000 * factor).alias("costUsdTicks"),
            (F.col("k") % 2 == 1).alias("costIsPartial"),
        ]

    per_model = F.create_map(
        F.lit("grok-4.5"), F.struct(*counters(1)), F.lit("grok-4.5-build"), F.struct(*counters(3))
    )
    use = F.struct(*counters(1)[:5], F.when(F.col("event_type") != "purchase", per_model).alias("modelUsage"))
    update = F.struct(
        F.when(F.col("event_type") == "view", "usage_snapshot")
        .when(F.col("event_type") != "signup", "turn_completed")
        .alias("sessionUpdate"),
        F.when(F.col("event_type") != "click", F.concat(F.lit("p"), "event_id")).alias("prompt_id"),
        use.alias("usage"),
    )

    def record(timestamp: Column) -> Column:
        return F.to_json(
            F.struct(
                timestamp.alias("timestamp"),
                F.lit("_x.ai/session/update").alias("method"),
                F.struct(update.alias("update")).alias("params"),
            )
        )

    by_kind = (
        F.when(F.col("k") % 3 == 0, record(F.col("t")))
        .when(F.col("k") % 3 == 1, record(F.col("t") * 1000 + 456))
        .otherwise(record(iso(F.col("t"))))
    )
    return written(
        e,
        file_path=F.concat(F.lit("/home/sessions/s-"), "user_id", F.lit("/updates.jsonl")),
        line_no=F.col("event_id"),
        value=by_kind,
    )


def ingest_grok(spark, sf):
    rows = grok_usage(settled_events(grok_events(grok_lines(spark, sf)), SETTLED_AT))
    return rows.select(
        *ROW, "latency_ms", F.round("reported_cost", 6).cast("double").alias("reported_cost"), "reported_partial"
    )


def grok_deferred(spark, sf):
    return deferred_files(grok_events(grok_lines(spark, sf)), SETTLED_AT)


# --- rollout logs ----------------------------------------------------------------------------


def thread_uuid(user: Column) -> Column:
    return F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(user.cast("string"), 12, "0"))


def rollout_path(user: Column) -> Column:
    return F.concat(F.lit("/home/sessions/2024/rollout-"), thread_uuid(user), F.lit(".jsonl"))


def counter_line() -> Column:
    """A token_count event: cumulative totals, or for views only the last request."""
    event = F.col("event_id")
    totals = F.struct(
        (event * 3 + 100).alias("input_tokens"),
        event.alias("cached_input_tokens"),
        (event * 2 + F.col("k")).alias("output_tokens"),
        (event * 5 + F.col("k") + 100).alias("total_tokens"),
    )
    last = F.struct(
        F.col("k").alias("input_tokens"), (F.col("k") * 2).alias("cache_read_input_tokens"), F.lit(0).alias("output_tokens")
    )
    view = F.col("event_type") == "view"
    info = F.struct(
        F.when(F.col("event_type") == "purchase", "OpenAI/GPT-5.6-SOL-20260305").alias("model"),
        F.when(~view, totals).alias("total_token_usage"),
        F.when(view, last).alias("last_token_usage"),
    )
    payload = F.struct(F.lit("token_count").alias("type"), info.alias("info"))
    return F.to_json(F.struct(F.lit("event_msg").alias("type"), iso(F.col("t")).alias("timestamp"), payload.alias("payload")))


def meta_line(user: Column, at: Column, parent: Column | None = None) -> Column:
    fields = [thread_uuid(user).alias("id")]
    if parent is not None:
        fields.append(parent.alias("forked_from_id"))
    return F.to_json(
        F.struct(F.lit("session_meta").alias("type"), iso(at).alias("timestamp"), F.struct(*fields).alias("payload"))
    )


def _lines_of(e, owner: Column):
    """Context and counter lines of events in the log of ``owner``."""
    context = F.to_json(
        F.struct(F.lit("turn_context").alias("type"), F.struct(F.lit("gpt-5.5-2026-01-02").alias("model")).alias("payload"))
    )
    pairs = F.array_compact(
        F.array(
            F.when(F.col("event_type") == "signup", F.struct(F.lit(1).alias("x"), context.alias("value"))),
            F.struct(F.lit(2).alias("x"), counter_line().alias("value")),
        )
    )
    return e.select(owner.alias("owner"), "event_id", F.explode(pairs).alias("p")).select(
        "owner", (F.col("event_id") * 4 + F.col("p.x")).alias("line_no"), F.col("p.value").alias("value")
    )


def _as_lines(df):
    path = rollout_path(F.col("owner"))
    return df.select(
        path.alias("file_path"), F.element_at(F.split(path, "/"), -1).alias("file_name"), "line_no", "value"
    )


def plain_threads(spark, sf):
    e = events(spark, sf)
    metas = e.groupBy(F.col("user_id").alias("owner")).agg(F.min("t").alias("t"))
    meta = metas.select("owner", F.lit(0).cast("bigint").alias("line_no"), meta_line(F.col("owner"), F.col("t")).alias("value"))
    return _as_lines(_lines_of(e, F.col("user_id")).unionByName(meta))


def forked_threads(spark, sf):
    """Even users are parents; each odd user's log starts with a copy of its parent's up to the fork."""
    return _as_lines(forked_lines(events(spark, sf)))


def forked_lines(e):
    """(owner, line_no, value) of the forked threads; a filter by owner comes before the text is made."""
    user, odd = F.col("user_id"), F.col("user_id") % 2 == 1
    parents = e.filter(~odd)
    own = _lines_of(parents, user)
    copied = _lines_of(parents.filter(F.col("t") <= FORK), user + 1)
    later = _lines_of(e.filter(odd & (F.col("t") > FORK)), user)
    owners = e.select(user.alias("owner")).union(parents.select(user + 1)).distinct()
    forked = F.col("owner") % 2 == 1
    at = F.when(forked, F.lit(FORK)).otherwise(F.lit(T0))
    meta = owners.select(
        "owner",
        F.lit(0).cast("bigint").alias("line_no"),
        meta_line(F.col("owner"), at, F.when(forked, thread_uuid(F.col("owner") - 1))).alias("value"),
    )
    return own.unionByName(copied).unionByName(later).unionByName(meta)


def counter_deltas(spark, sf):
    records = staged(rollout_records(plain_threads(spark, sf)), "records")
    return rollout_usage(token_events(records), NOW).select(*ROW)


def replay_trim(spark, sf):
    return rollout_rows(forked_threads(spark, sf), NOW)[0].select(*ROW)


def replay_prefixes(spark, sf):
    """Length of the replayed prefix per forked thread."""
    records, threads, token_rows = rollout_tables(forked_threads(spark, sf))
    prefixes = replay_prefix(threads, token_rows, parent_timeline(records))
    return prefixes.select(
        F.regexp_extract("file_path", "([0-9]+)\\.jsonl$", 1).cast("bigint").alias("user_id"),
        F.col("replay_prefix").cast("bigint").alias("replay_prefix"),
    )


def thread_status(spark, sf):
    """How each thread is classified; a thread whose parent has no log waits for it."""
    threads = rollout_tables(forked_threads(spark, sf))[1]
    return threads.groupBy("parent_status", F.coalesce("pending", F.lit("ready")).alias("state")).agg(
        F.count("*").alias("threads")
    )


def thread_index(spark, sf):
    index = rollout_index(forked_threads(spark, sf).select("file_path", "file_name").distinct())
    return index.select("thread_id", F.size("paths").cast("bigint").alias("files"))


# --- ingest-time dedup --------------------------------------------------------------------


def _session_rows(spark, sf):
    return usage(spark, sf).filter(F.col("data_source").isin(*SESSION_SOURCES))


def _stored(spark, sf):
    """What the fact table holds already: the proxy's records and those of failed requests."""
    return usage(spark, sf).filter((F.col("data_source") == "proxy") | (F.col("status_code") == 500))


def ingest_dedup_query(spark, sf):
    return ingest_dedup(_session_rows(spark, sf), _stored(spark, sf)).select("request_id", "app_type", "created_at")


def proximity(spark, sf):
    rows = usage(spark, sf).filter("data_source = 'grok_session'")
    return drop_near_activity(rows, usage(spark, sf)).select("request_id", "created_at")


# --- merging, cursors, transfer ------------------------------------------------------------


def merge_first_wins(spark, sf):
    """Every request arrives twice with other tokens; stored ones and second copies lose."""
    rows = usage(spark, sf)
    second = rows.withColumns({"output_tokens": F.col("output_tokens") + 1, "created_at": F.col("created_at") + 1})
    return new_rows(rows.unionByName(second), _stored(spark, sf)).select("request_id", "output_tokens", "created_at")


def merge_metrics(spark, sf):
    rows = usage(spark, sf)
    return merge_counts(rows.unionByName(rows), _stored(spark, sf))


def device_stamp(spark, sf):
    rows = usage(spark, sf).withColumn(
        "device_id", F.when(F.col("device_name") == "", "").otherwise(F.col("device_id"))
    )
    stamped = stamp_device(rows, "dev-home", "Home")
    return stamped.groupBy("device_id", "device_name").agg(F.count("*").alias("request_count"))


def _files(spark, sf):
    """One log per user, modified at its last event, some moved to the archive."""
    e = events(spark, sf)
    folder = F.when(F.col("user_id") % 3 == 0, "archived_sessions").otherwise("sessions")
    path = F.concat(F.lit("/home/"), folder, F.lit("/rollout-"), "user_id", F.lit(".jsonl"))
    return e.groupBy("user_id", path.alias("file_path")).agg(
        F.max("t").alias("file_modified_ns"), F.count("*").alias("n_lines")
    )


def _old_cursors(spark, sf):
    """Cursors of a sync ten days in, from before any file moved."""
    cut = T0 + 20 * 86400
    e = events(spark, sf).filter(F.col("t") <= cut)
    path = F.concat(F.lit("/home/sessions/rollout-"), "user_id", F.lit(".jsonl"))
    return e.groupBy(path.alias("file_path")).agg(
        F.max("t").alias("last_modified"), F.count("*").alias("last_line_offset"), F.lit(cut).alias("last_synced_at")
    )


def cursor_skip(spark, sf):
    """Files to read again, with the lines already taken."""
    files, cursors = _files(spark, sf), _old_cursors(spark, sf)
    known = upsert(cursors, C.inherit_archived(files, cursors), ["file_path"])
    return C.changed_files(files, known).select("file_path", "n_lines", "last_line_offset")


def cursor_lines(spark, sf):
    """Unread lines per file: beyond the offset, in changed files only."""
    e = events(spark, sf)
    path = F.concat(F.lit("/home/sessions/rollout-"), "user_id", F.lit(".jsonl"))
    modified = e.groupBy("user_id").agg(F.max("t").alias("file_modified_ns"))
    lines = e.join(modified, "user_id").select(path.alias("file_path"), "file_modified_ns", F.col("event_id").alias("line_no"))
    seen = C.line_cursors(lines.filter(F.col("line_no") <= 500), NOW).withColumn("last_modified", F.lit(T0))
    return C.unread_lines(lines, seen).groupBy("file_path").agg(F.count("*").alias("unread"), F.min("line_no").alias("first_line"))


def rebuild_delete(spark, sf):
    """Rows kept when the rollouts of paying users are rebuilt."""
    payers = events(spark, sf).filter("event_type = 'purchase'")
    files = payers.select(F.concat(F.lit("s-"), "user_id").alias("thread_id")).distinct()
    return forget_sessions(usage(spark, sf), files).select("request_id", "data_source")


def rebuild_cursors(spark, sf):
    return forget_cursors(_old_cursors(spark, sf), _files(spark, sf)).select("file_path", "last_line_offset")


def export_import(spark, sf):
    """Export everything, import it where failed requests are already known."""
    path = new_path(spark, "export")
    export_usage(usage(spark, sf), path, "dev-a", "Device A", NOW)
    rows = import_usage(read_export(spark, path), _stored(spark, sf))
    return rows.select(
        "request_id", "model", "output_tokens", F.round("total_cost_usd", 6).cast("double").alias("total_cost_usd"), "is_streaming", "created_at"
    )


def import_documents(spark, sf):
    """The same records as transfers in single-document form, one document per session."""
    rows = usage(spark, sf)
    record = F.struct(*to_records(rows).columns)
    of_session = to_records(rows).withColumn("owner", F.col("sessionId")).groupBy("owner").agg(F.collect_list(record).alias("records"))
    device = F.struct(F.lit("dev-a").alias("id"), F.lit("Device A").alias("name"))
    body = F.struct(F.lit(TRANSFER_VERSION).alias("schemaVersion"), F.lit(NOW).alias("exportedAt"), device.alias("sourceDevice"), "records")
    documents = of_session.select(F.to_json(body).alias("value"))
    out = import_usage(read_documents(documents), _stored(spark, sf))
    return out.select(
        "request_id", "model", "output_tokens", F.round("total_cost_usd", 6).cast("double").alias("total_cost_usd"), "is_streaming", "created_at"
    )


def import_counts(spark, sf):
    path = new_path(spark, "export")
    export_usage(usage(spark, sf), path, "dev-a", "Device A", NOW)
    return import_summary(read_export(spark, path), _stored(spark, sf))


def multi_source(spark, sf):
    """All sources into one table that holds the proxy's records; one more source fails and is only reported."""

    sf = spread(spark, sf, "events", "event_id")

    def broken():
        raise OSError("source not readable")

    def grok():
        return grok_usage(settled_events(grok_events(grok_lines(spark, sf)), SETTLED_AT))

    fact = staged(usage(spark, sf), "fact")  # a stored table, that each source is compared with
    rows, report = ingest_all(
        spark,
        {
            "session_log": lambda: claude_usage(claude_lines(spark, sf), NOW),
            "codex_session": lambda: rollout_rows(plain_threads(spark, sf), NOW)[0],
            "gemini_session": lambda: gemini_usage(gemini_documents(spark, sf), NOW),
            "opencode_session": lambda: opencode_usage(opencode_tables(spark, sf)[1], NOW),
            "zcode_session": lambda: zcode_usage(zcode_tables(spark, sf)[1], NOW),
            "grok_session": grok,
            "lost_session": broken,
        },
        fact,
        seed_prices(spark),
        device_id="dev-home",
        device_name="Home",
    )
    stored = rows.groupBy("data_source").agg(
        F.sum("output_tokens").alias("output_tokens"), F.round(F.sum("total_cost_usd"), 6).cast("double").alias("total_cost")
    )
    return report.join(stored, "data_source", "left").select(
        "data_source", "imported", "skipped", F.col("error").isNotNull().alias("failed"), "output_tokens", "total_cost"
    )


QUERIES = {
    "ingest_claude": ingest_claude,
    "sync_files": sync_claude_files,
    "ingest_gemini": ingest_gemini,
    "ingest_opencode": ingest_opencode,
    "opencode_watermarks": opencode_watermarks,
    "ingest_zcode": ingest_zcode,
    "zcode_watermarks": zcode_watermarks,
    "ingest_grok": ingest_grok,
    "grok_deferred": grok_deferred,
    "counter_deltas": counter_deltas,
    "replay_trim": replay_trim,
    "replay_prefixes": replay_prefixes,
    "thread_status": thread_status,
    "thread_index": thread_index,
    "ingest_dedup": ingest_dedup_query,
    "proximity_suppression": proximity,
    "merge_first_wins": merge_first_wins,
    "merge_metrics": merge_metrics,
    "device_stamp": device_stamp,
    "cursor_skip": cursor_skip,
    "cursor_lines": cursor_lines,
    "rebuild_delete": rebuild_delete,
    "rebuild_cursors": rebuild_cursors,
    "export_import_roundtrip": export_import,
    "import_documents": import_documents,
    "import_counts": import_counts,
    "multi_source_union": multi_source,
}

# --- SQL ---------------------------------------------------------------------------------------

_E = f"WITH {EVENTS_SQL}, m AS (SELECT *, {sql_case('user_id % 6', MODELS)} AS model, CAST(floor(value * 100) AS BIGINT) AS inp, CASE WHEN k = 7 THEN 4294967295 ELSE CAST(floor(value * 100) AS BIGINT) END AS wild FROM e)"

_CLAUDE = f"""{_E}, since AS (SELECT user_id, MIN(event_id) * 2 AS line FROM e WHERE event_type = 'click' GROUP BY 1),
best AS (SELECT *, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS final FROM m WHERE event_type <> 'view'),
claude AS (
SELECT 'session:m' || event_id AS request_id, 'claude' AS app_type, model, wild AS input_tokens,
  CASE WHEN final = 1 THEN k * 11 ELSE k * 20 END AS output_tokens, k * 50 AS cache_read_tokens,
  CASE WHEN k > 50 THEN k ELSE 0 END AS cache_creation_tokens,
  CASE WHEN since.line <= event_id * 2 + final THEN 's-' || best.user_id END AS session_id,
  CASE WHEN event_type = 'signup' THEN {NOW} ELSE t END AS created_at
FROM best LEFT JOIN since USING (user_id) WHERE wild > 0 OR k > 0)"""

_GEMINI = f"""{_E}, gemini AS (
SELECT 'gemini_session:' || CASE WHEN event_type = 'signup' THEN 'unknown' ELSE 'c' || event_id END || ':' ||
  CASE WHEN event_type = 'error' THEN 'unknown' ELSE 'g' || event_id END AS request_id, 'gemini' AS app_type, model,
  wild AS input_tokens, k * 3 AS output_tokens, k * 3 AS cache_read_tokens, 0::BIGINT AS cache_creation_tokens,
  CASE WHEN event_type <> 'signup' THEN 'c' || event_id END AS session_id, t AS created_at
FROM m WHERE inp > 0 OR k > 0)"""

_OPENCODE = f"""{_E}, opencode AS (
SELECT 'opencode_session:s-' || user_id || ':m' || event_id AS request_id, 'opencode' AS app_type, model,
  wild AS input_tokens, k * 3 AS output_tokens, k * 5 AS cache_read_tokens, k * 7 AS cache_creation_tokens,
  's-' || user_id AS session_id, t AS created_at,
  CASE WHEN event_type = 'purchase' AND k <> 9 AND round(value, 2) > 0 THEN round(value, 2) END AS reported_cost
FROM m WHERE (inp > 0 OR k > 0) AND event_type NOT IN ('view', 'error'))"""

_GROK = f"""{_E}, young AS (SELECT user_id, MIN(event_id) AS barrier FROM e
  WHERE event_type <> 'view' AND {SETTLED_AT} - t < 600 GROUP BY 1),
turns AS (SELECT m.*, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx FROM m WHERE event_type <> 'view'),
grok AS (
SELECT 'grok_session:s-' || user_id || ':' || CASE WHEN event_type = 'click' THEN 'idx' || idx ELSE 'p' || event_id END
    || ':' || g.name AS request_id, 'grokbuild' AS app_type, g.name AS model, inp * g.f AS input_tokens, k * g.f AS output_tokens,
  k * 2 * g.f AS cache_read_tokens, 0::BIGINT AS cache_creation_tokens, 's-' || user_id AS session_id, t AS created_at,
  k * 100 AS latency_ms, CASE WHEN k > 0 THEN ROUND(k * g.f * 0.0001, 6)::DOUBLE END AS reported_cost,
  k % 2 = 1 AND g.name <> 'unknown' AS reported_partial
FROM turns LEFT JOIN young USING (user_id),
  (VALUES ('grok-4.5', 1), ('grok-4.5-build', 3), ('unknown', 1)) AS g(name, f)
WHERE (g.name = 'unknown') = (event_type = 'purchase') AND (inp > 0 OR k > 0)
  AND (barrier IS NULL OR event_id < barrier))"""


_ZCODE = f"""{_E}, z AS (
  SELECT *, CASE WHEN k = 7 THEN 4294967295 ELSE inp END AS zin, CASE WHEN k = 8 THEN 0 ELSE k END AS zout FROM m),
zcode AS (
SELECT 'zcode_session:z' || event_id AS request_id, 'zcode' AS app_type, model, zin AS input_tokens,
  zout + k * 2 AS output_tokens, CASE WHEN k > 10 THEN k * 4 ELSE 0 END AS cache_read_tokens,
  k * 3 AS cache_creation_tokens, 's-' || user_id AS session_id,
  CASE WHEN event_type = 'click' THEN t + 5 ELSE t END AS created_at, GREATEST(k * 9 - 50, 0) AS latency_ms,
  CASE WHEN k > 3 THEN GREATEST(k - 20, 0) END AS first_token_ms
FROM z WHERE event_type <> 'error' AND (zin > 0 OR k > 0))"""


def _rollout_sql(source: str, name: str = "deltas") -> str:
    """Deltas over ``source`` (owner, event columns), by LAG over the total events."""
    return f"""
totals AS (SELECT owner, event_id,
    LAG(event_id) OVER (PARTITION BY owner ORDER BY event_id) AS pe,
    LAG(k) OVER (PARTITION BY owner ORDER BY event_id) AS pk
  FROM {source} WHERE event_type <> 'view'),
steps AS (
  SELECT s.*, CASE WHEN s.event_type = 'view' THEN k WHEN pe IS NULL THEN s.event_id * 3 + 100
                   ELSE (s.event_id - pe) * 3 END AS d_in,
    CASE WHEN s.event_type = 'view' THEN k WHEN pe IS NULL THEN s.event_id ELSE s.event_id - pe END AS d_read,
    CASE WHEN s.event_type = 'view' THEN 0 WHEN pe IS NULL THEN s.event_id * 2 + k
         ELSE GREATEST((s.event_id - pe) * 2 + k - pk, 0) END AS d_out,
    MAX(CASE WHEN event_type IN ('signup', 'purchase') THEN s.event_id END)
      OVER (PARTITION BY s.owner ORDER BY s.event_id) AS named
  FROM {source} s LEFT JOIN totals USING (owner, event_id)),
numbered AS (
  SELECT *, SUM(CASE WHEN d_in > 0 OR d_read > 0 OR d_out > 0 THEN 1 ELSE 0 END)
              OVER (PARTITION BY owner ORDER BY event_id) AS event_index FROM steps),
{name} AS (
  SELECT 'codex_session:thread-v1:00000000-0000-4000-8000-' || lpad(n.owner::VARCHAR, 12, '0') || ':'
      || event_index::BIGINT AS request_id, 'codex' AS app_type,
    COALESCE(CASE (SELECT event_type FROM e WHERE e.event_id = named)
      WHEN 'signup' THEN 'gpt-5.5' WHEN 'purchase' THEN 'gpt-5.6-sol' END, 'unknown') AS model,
    d_in AS input_tokens, d_out AS output_tokens, LEAST(d_read, d_in) AS cache_read_tokens,
    0::BIGINT AS cache_creation_tokens,
    '00000000-0000-4000-8000-' || lpad(n.owner::VARCHAR, 12, '0') AS session_id, t AS created_at, n.user_id, n.owner
  FROM numbered n WHERE d_in > 0 OR d_read > 0 OR d_out > 0)"""


_PLAIN = f"{_E}, src AS (SELECT *, user_id AS owner FROM e),{_rollout_sql('src')}"
_FORKED = f"""{_E}, src AS (
  SELECT *, user_id AS owner FROM e WHERE user_id % 2 = 0
  UNION ALL SELECT *, user_id + 1 FROM e WHERE user_id % 2 = 0 AND t <= {FORK}
  UNION ALL SELECT *, user_id FROM e WHERE user_id % 2 = 1 AND t > {FORK}),{_rollout_sql('src')}"""

_ROW = ", ".join(ROW)
_SHARED = _ROW.replace("session_id, ", "")
_SESSION = "data_source <> 'proxy'"
_STORED = "(data_source = 'proxy' OR status_code = 500)"

ORACLES = {
    "ingest_claude": f"{_CLAUDE} SELECT {_ROW} FROM claude",
    "sync_files": f"""{_E}, since AS (SELECT user_id, t >= {WAVE} AS late, MIN(event_id) AS first FROM e WHERE event_type = 'click' GROUP BY ALL)
SELECT CASE WHEN t >= {WAVE} THEN 1 ELSE 0 END AS wave, 'session:m' || event_id AS request_id, 'claude' AS app_type, model,
  wild AS input_tokens, CASE WHEN event_type = 'error' THEN k * 20 ELSE k * 11 END AS output_tokens, k * 50 AS cache_read_tokens,
  CASE WHEN k > 50 THEN k ELSE 0 END AS cache_creation_tokens, CASE WHEN first <= event_id THEN 's-' || m.user_id END AS session_id,
  CASE WHEN event_type = 'signup' THEN {NOW} ELSE t END AS created_at
FROM m LEFT JOIN since ON since.user_id = m.user_id AND late = (t >= {WAVE}) WHERE event_type <> 'view' AND (wild > 0 OR k > 0)""",
    "ingest_gemini": f"{_GEMINI} SELECT {_ROW} FROM gemini",
    "ingest_opencode": f"{_OPENCODE} SELECT {_ROW}, reported_cost FROM opencode",
    "opencode_watermarks": f"""{_E}, w AS (SELECT 's-' || user_id AS session_id, MAX(t) * 1000 + 900 AS watermark,
  COUNT(*) FILTER (WHERE event_type = 'error') AS open FROM e GROUP BY 1)
SELECT session_id, watermark, open = 0 AS advances FROM w WHERE watermark >= {(T0 + 29 * 86400) * 1000}""",
    "ingest_zcode": f"{_ZCODE} SELECT {_ROW}, latency_ms, first_token_ms FROM zcode",
    "zcode_watermarks": f"""{_E} SELECT 's-' || user_id AS session_id,
  GREATEST(COALESCE(MAX(CASE WHEN event_type <> 'error' THEN t * 1000 + 5000 END), 0),
           COALESCE(MAX(CASE WHEN event_type = 'signup' THEN t * 1000 + 5000 END), MIN(t) * 1000)) AS watermark,
  COUNT(*) FILTER (WHERE event_type = 'error') AS incomplete FROM e GROUP BY 1""",
    "ingest_grok": f"{_GROK} SELECT {_ROW}, latency_ms, reported_cost, reported_partial FROM grok",
    "grok_deferred": f"{_GROK} SELECT '/home/sessions/s-' || user_id || '/updates.jsonl' AS file_path FROM young",
    "counter_deltas": f"{_PLAIN} SELECT {_ROW} FROM deltas",
    "replay_trim": f"{_FORKED} SELECT {_ROW} FROM deltas WHERE user_id = owner AND owner - 1 + owner % 2 IS NOT NULL AND (owner % 2 = 0 OR owner - 1 IN (SELECT user_id FROM e))",
    "replay_prefixes": f"""{_E} SELECT p.owner AS user_id, p.n AS replay_prefix FROM (
  SELECT user_id + 1 AS owner, COUNT(*) FILTER (WHERE t <= {FORK}) AS n, MAX(t) AS until FROM e WHERE user_id % 2 = 0 GROUP BY 1) p
WHERE until >= {FORK} AND (n > 0 OR owner IN (SELECT user_id FROM e WHERE t > {FORK}))""",
    "thread_status": f"""{_E}, owners AS (SELECT user_id AS owner FROM e UNION SELECT user_id + 1 FROM e WHERE user_id % 2 = 0),
parents AS (SELECT user_id, MAX(t) AS until FROM e WHERE user_id % 2 = 0 GROUP BY 1)
SELECT CASE WHEN owner % 2 = 1 THEN 'parent' ELSE 'none' END AS parent_status,
  CASE WHEN owner % 2 = 0 THEN 'ready' WHEN p.user_id IS NULL THEN 'missing_parent'
       WHEN until < {FORK} THEN 'retryable' ELSE 'ready' END AS state, COUNT(*) AS threads
FROM owners LEFT JOIN parents p ON p.user_id = owner - 1 GROUP BY 1, 2""",
    "thread_index": f"""{_E}, owners AS (SELECT user_id AS owner FROM e UNION SELECT user_id + 1 FROM e WHERE user_id % 2 = 0)
SELECT '00000000-0000-4000-8000-' || lpad(owner::VARCHAR, 12, '0') AS thread_id, 1::BIGINT AS files FROM owners""",
    "ingest_dedup": f"""{WITH_USAGE}, hit AS (SELECT DISTINCT l.request_id FROM u l JOIN u p ON {MATCH_BY_APP})
SELECT request_id, app_type, created_at FROM u WHERE {_SESSION} AND status_code <> 500
  AND request_id NOT IN (SELECT request_id FROM hit)""",
    "proximity_suppression": f"""{WITH_USAGE}, hit AS (
  SELECT DISTINCT l.request_id FROM u l JOIN u p ON p.created_at BETWEEN l.created_at - 600 AND l.created_at + 600
  WHERE l.data_source = 'grok_session' AND p.data_source = 'proxy' AND p.app_type = 'grokbuild')
SELECT request_id, created_at FROM u WHERE data_source = 'grok_session' AND request_id NOT IN (SELECT request_id FROM hit)""",
    "merge_first_wins": f"{WITH_USAGE} SELECT request_id, output_tokens, created_at FROM u WHERE NOT {_STORED}",
    "merge_metrics": f"""{WITH_USAGE} SELECT COUNT(*) FILTER (WHERE NOT {_STORED}) AS imported,
  COUNT(*) * 2 - COUNT(*) FILTER (WHERE NOT {_STORED}) AS skipped FROM u""",
    "device_stamp": f"""{WITH_USAGE} SELECT CASE WHEN device_name = '' THEN 'dev-home' ELSE device_id END AS device_id,
  CASE WHEN device_name = '' THEN 'Home' ELSE device_name END AS device_name, COUNT(*) AS request_count FROM u GROUP BY 1, 2""",
    "cursor_skip": f"""{_E}, f AS (SELECT user_id, MAX(t) AS modified, COUNT(*) AS n_lines,
  COUNT(*) FILTER (WHERE t <= {T0 + 20 * 86400}) AS taken FROM e GROUP BY 1)
SELECT '/home/' || CASE WHEN user_id % 3 = 0 THEN 'archived_sessions' ELSE 'sessions' END || '/rollout-' || user_id
  || '.jsonl' AS file_path, n_lines, taken AS last_line_offset FROM f WHERE n_lines > taken""",
    "cursor_lines": f"""{_E}, seen AS (SELECT user_id, COALESCE(MAX(event_id) FILTER (WHERE event_id <= 500), 0) AS upto,
  MAX(t) AS modified, COUNT(*) FILTER (WHERE event_id <= 500) AS n FROM e GROUP BY 1)
SELECT '/home/sessions/rollout-' || user_id || '.jsonl' AS file_path, COUNT(*) AS unread, MIN(event_id) AS first_line
FROM e JOIN seen USING (user_id) WHERE event_id > upto GROUP BY user_id""",
    "rebuild_delete": f"""{WITH_USAGE} SELECT request_id, data_source FROM u
WHERE NOT (data_source = 'codex_session' AND session_id IN (SELECT 's-' || user_id FROM e WHERE event_type = 'purchase'))""",
    "rebuild_cursors": f"""{_E} SELECT '/home/sessions/rollout-' || user_id || '.jsonl' AS file_path,
  COUNT(*) AS last_line_offset FROM e WHERE t <= {T0 + 20 * 86400} AND user_id % 3 = 0 GROUP BY user_id""",
    "export_import_roundtrip": f"""{WITH_USAGE} SELECT request_id, model, output_tokens, {money('total_cost_usd')} AS total_cost_usd,
  true AS is_streaming, created_at FROM u WHERE NOT {_STORED}""",
    "import_documents": f"""{WITH_USAGE} SELECT request_id, model, output_tokens, {money('total_cost_usd')} AS total_cost_usd,
  true AS is_streaming, created_at FROM u WHERE NOT {_STORED}""",
    "import_counts": f"""{WITH_USAGE} SELECT COUNT(*) FILTER (WHERE NOT {_STORED}) AS imported,
  COUNT(*) FILTER (WHERE {_STORED}) AS skipped, COUNT(DISTINCT device_id) AS device_count FROM u""",
    "multi_source_union": f"""{_CLAUDE}, {_GEMINI.removeprefix(_E + ', ')}, {_OPENCODE.removeprefix(_E + ', ')},
{_GROK.removeprefix(_E + ', ')}, {_ZCODE.removeprefix(_E + ', ')}, {_PLAIN.removeprefix(_E + ', ')},
{WITH_USAGE.split(EVENTS_SQL + ',', 1)[1]},
price(name, pi, po, pr, pw) AS (SELECT c0, c1::DECIMAL(10,6), c2::DECIMAL(10,6), c3::DECIMAL(10,6), c4::DECIMAL(10,6) FROM (VALUES
    ('claude-sonnet-4-6', 3, 15, 0.3, 3.75), ('gpt-5.2', 1.75, 14, 0.175, 0), ('glm-5.2', 0.63, 1.98, 0.0945, 0),
    ('gpt-5.5', 5, 30, 0.5, 0), ('gpt-5.6-sol', 5, 30, 0.5, 6.25), ('grok-4.5', 2, 6, 0.5, 0),
    ('grok-4.5-build', 2, 6, 0.3, 0)) AS v(c0, c1, c2, c3, c4)),
rows_ AS (SELECT 'session_log' AS data_source, {_SHARED}, NULL::DOUBLE AS reported_cost, false AS partial FROM claude
  UNION ALL SELECT 'codex_session', {_SHARED}, NULL, false FROM deltas
  UNION ALL SELECT 'gemini_session', {_SHARED}, NULL, false FROM gemini
  UNION ALL SELECT 'opencode_session', {_SHARED}, reported_cost, false FROM opencode
  UNION ALL SELECT 'zcode_session', {_SHARED}, NULL, false FROM zcode
  UNION ALL SELECT 'grok_session', {_SHARED}, reported_cost, reported_partial FROM grok),
seen AS (SELECT DISTINCT l.data_source, l.request_id FROM rows_ l JOIN u p ON {MATCH_BY_APP}
  UNION SELECT DISTINCT l.data_source, l.request_id FROM rows_ l JOIN u p ON p.created_at BETWEEN l.created_at - 600 AND l.created_at + 600
  WHERE l.data_source = 'grok_session' AND p.data_source = 'proxy' AND p.app_type = 'grokbuild'),
fresh AS (SELECT r.*, name IS NOT NULL AS found,
    CASE WHEN data_source IN ('codex_session', 'gemini_session', 'grok_session', 'zcode_session')
         THEN GREATEST(input_tokens - cache_read_tokens - cache_creation_tokens, 0) ELSE input_tokens END AS billable, pi, po, pr, pw
  FROM rows_ r ANTI JOIN seen USING (data_source, request_id)
  LEFT JOIN price ON name = regexp_replace(lower(model), '-[0-9]{{8}}$', '')),
costed AS (SELECT *, CASE WHEN reported_cost IS NOT NULL AND (data_source = 'opencode_session' OR NOT found OR NOT partial)
    THEN CAST(reported_cost AS DECIMAL(18,6)) WHEN found THEN {sql_cost('billable', 'pi')} + {sql_cost('output_tokens', 'po')}
      + {sql_cost('cache_read_tokens', 'pr')} + {sql_cost('cache_creation_tokens', 'pw')} ELSE 0 END AS cost FROM fresh),
offered AS (SELECT data_source, COUNT(*) AS n FROM rows_ GROUP BY 1)
SELECT data_source, COUNT(cost) AS imported, any_value(n) - COUNT(cost) AS skipped, false AS failed,
  {big('SUM(output_tokens)')} AS output_tokens, {money('SUM(cost)')} AS total_cost
FROM offered LEFT JOIN costed USING (data_source) GROUP BY 1
UNION ALL SELECT 'lost_session', 0, 0, true, NULL, NULL""",
}
