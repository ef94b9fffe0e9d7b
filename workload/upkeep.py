"""Queries over stored tables, files and ranges: what keeps the fact table right from day to day."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokentide.functions.times import make_range
from tokentide.operators import analytics as A
from tokentide.operators.dedup import effective_usage
from tokentide.operators.filters import UsageQuery
from tokentide.operators.merge import new_rows, rewrite_days, upsert, write_usage
from tokentide.operators.pricing import seed_prices
from tokentide.operators.transfer import import_usage, read_large_documents, to_records
from tokentide.plans.ingest import ingest_all
from tokentide.plans.rollup import refresh_rollup, rollup_table
from tokentide.plans.sync import PENDING, sync_rollout_files
from tokentide.schema import CURSOR_SCHEMA, TRANSFER_VERSION
from tokentide.session import new_path, staged
from tokentide.sources.claude import claude_usage
from tokentide.sources.grok import deferred_files, grok_events, grok_usage, settled_events
from tokentide.sources.lines import list_files, read_files, write_logs
from tokentide.streaming import pipelines as S

from .logs import _FORKED, _GROK, _ROW, _STORED, NOW, ROW, SETTLED_AT, _stored, claude_lines, forked_lines, grok_lines, thread_uuid
from .reports import daily_sql
from .views import T0, WITH_EFFECTIVE, WITH_USAGE, events, usage

DAY = 86400
#: The clock of the presets: a morning in January, so that ninety days reach into summer time.
CLOCK = T0 + 20 * DAY + 5 * 3600


def range_presets(spark, sf):
    """Requests in each named range, as seen from Berlin."""
    rows = usage(spark, sf)
    out = None
    for preset in ("today", "1d", "7d", "14d", "30d", "90d", "all", "custom"):
        start, end = make_range(preset, CLOCK, "Europe/Berlin", start=T0 + DAY if preset == "custom" else None)
        part = effective_usage(rows, UsageQuery(start, end)).agg(F.count("*").alias("requests"))
        part = part.select(F.lit(preset).alias("preset"), F.lit(start).alias("range_start"), F.lit(end).alias("range_end"), "requests")
        out = part if out is None else out.unionByName(part)
    return out


#: Imports with faults: what is wrong in them, in which records.
FAULTS = {
    "negative_count": ("output_tokens", "-1", "event % 50 = 7"),
    "blank_model": ("model", "' '", "event % 70 = 3"),
    "no_id": ("request_id", "null", "event % 90 = 5"),
    "no_time": ("created_at", "0", "event % 40 = 9"),
    "no_provider": ("provider_id", "''", "event % 30 = 1"),
    "none": ("model", "model", "false"),
}


def import_rejected(spark, sf):
    """One invalid record rejects its import: invalid records and rows to append, by import."""
    rows, made = usage(spark, sf).withColumn("event", F.substring("request_id", 4, 20).cast("bigint")), []
    for name, (column, value, where) in FAULTS.items():
        sent = rows.withColumn(column, F.expr(f"case when {where} then {value} else {column} end").cast(rows.schema[column].dataType)).drop("event")
        try:
            made.append((name, 0, import_usage(sent, _stored(spark, sf)).count()))
        except ValueError as refused:
            made.append((name, int(str(refused).split()[0]), 0))
    return spark.createDataFrame(made, "import string, invalid bigint, imported bigint")


def ingest_report(spark, sf):
    """Files that each source looked at and deferred, beside what came of them."""
    claude, updates = staged(claude_lines(spark, sf), "claude-lines"), staged(grok_lines(spark, sf), "grok-lines")
    grok = staged(grok_events(updates), "grok-events")
    no, yes = F.lit(False).alias("deferred"), F.lit(True).alias("_young")
    young = deferred_files(grok, SETTLED_AT).select("file_path").distinct()
    grok_files = updates.select("file_path").distinct().join(young.select("file_path", yes), "file_path", "left")
    _, report = ingest_all(
        spark,
        {"session_log": lambda: claude_usage(claude, NOW), "grok_session": lambda: grok_usage(settled_events(grok, SETTLED_AT))},
        usage(spark, sf).filter("false"),
        seed_prices(spark),
        scans={
            "session_log": claude.select("file_path").distinct().select("file_path", no),
            "grok_session": grok_files.select("file_path", F.coalesce("_young", F.lit(False)).alias("deferred")),
        },
    )
    return report.select("data_source", "imported", "skipped", "files_scanned", "deferred_files")


def rewrite_stored(spark, sf):
    """The fact table, stored by day, after one session's model was corrected in place."""
    path = new_path(spark, "fact")
    write_usage(usage(spark, sf), path)
    wrong = F.col("session_id") == "s-5"
    stored = spark.read.parquet(path)
    rewrite_days(stored.withColumn("model", F.when(wrong, "corrected").otherwise(F.col("model"))), wrong, path)
    return spark.read.parquet(path).select("request_id", "model", F.date_format("event_date", "yyyy-MM-dd").alias("event_date"))


def merge_indexed(spark, sf):
    """As merge_first_wins, against the hash index of the stored ids."""
    log = S.usage_log(spark, new_path(spark, "fact"))
    S.ingest_batch(log)(_stored(spark, sf), 0)
    rows = usage(spark, sf)
    second = rows.withColumns({"output_tokens": F.col("output_tokens") + 1, "created_at": F.col("created_at") + 1})
    batch = rows.unionByName(second)
    return new_rows(batch, S.id_index(log).latest(only=batch)).select("request_id", "output_tokens", "created_at")


def sync_rollout_logs(spark, sf):
    """Rollout logs as real files in two waves: forks whose parents' logs turn up later wait for them.

    Rows by pass, and the threads that still wait after both.
    """
    named = F.concat(F.lit("rollout-"), F.regexp_extract("file_path", "thread=([^/]+)/", 1), F.lit(".jsonl"))
    read = lambda session, due: read_files(session, due).withColumn("file_name", named)
    lines = forked_lines(events(spark, sf)).select(thread_uuid(F.col("owner")).alias("thread"), "line_no", "value")
    folder = new_path(spark, "rollouts")
    cursors, pending = spark.createDataFrame([], CURSOR_SCHEMA), spark.createDataFrame([], PENDING)
    late = (F.substring("thread", -12, 12).cast("bigint") % 4) == 2  # parents that are missing at first
    out = None
    for wave, part in enumerate((~late, late)):
        write_logs(lines.filter(part), "thread", "line_no", folder)
        files = list_files(spark, folder, glob="*.txt").withColumn("file_name", named)
        rows, changes, pending = (staged(df, "sync") for df in sync_rollout_files(spark, files, cursors, pending, read, NOW, by_table=True))
        cursors = staged(upsert(cursors, changes, ["file_path"]), "cursors")
        rows = rows.select(F.lit(wave).alias("wave"), *ROW)
        out = rows if out is None else out.unionByName(rows)
    waits = pending.select(F.lit(2).alias("wave"), F.concat(F.lit("waits:"), F.regexp_extract("file_path", "thread=([^/]+)/", 1)).alias("request_id"))
    return out.unionByName(waits, allowMissingColumns=True)


def rollup_maintained(spark, sf):
    """The daily rollup of what reports count, kept up over two increments; proxy records of the first days come late."""
    rows = usage(spark, sf)
    late = (F.col("created_at") >= T0 + 12 * DAY) | (F.col("data_source") == "proxy")
    log = S.usage_log(spark, new_path(spark, "fact"))
    each, table = S.ingest_batch(log), rollup_table(spark, new_path(spark, "rollup"))
    for batch, part in enumerate((~late, late)):
        each(rows.filter(part), batch)
        refresh_rollup(table, log.read(), log.at(batch), batch)
    return table.latest()


def request_log_deep(spark, sf):
    """A page far down, from counts by time; the bound makes it look at hours and minutes too."""
    page = A.request_log_deep(effective_usage(usage(spark, sf)), 30, 25, rows=40)
    return page.select("request_id", "created_at", "model", "output_tokens")


def import_large_document(spark, sf):
    """All records as one transfer document in one file, parsed piece by piece."""
    rows = usage(spark, sf)
    first = rows.agg(F.min("request_id")).first()[0]
    comma = F.when(F.col("requestId") == first, "").otherwise(",")
    records = to_records(rows).select(F.when(F.col("requestId") == first, 1).otherwise(2).alias("at"), F.concat(comma, F.to_json(F.struct("*"))).alias("value"))
    head = f'{{"schemaVersion": {TRANSFER_VERSION}, "exportedAt": {NOW}, "sourceDevice": {{"id": "dev-a", "name": "Device A"}}, "records": ['
    ends = spark.createDataFrame([(0, head), (3, "]}")], "at int, value string")
    path = new_path(spark, "document")
    records.unionByName(ends).repartition(1).sortWithinPartitions("at").select("value").write.text(path)
    out = import_usage(read_large_documents(spark, path), _stored(spark, sf))
    return out.select("request_id", "model", "output_tokens", "device_id", "is_streaming", "created_at")


QUERIES = {
    "import_large_document": import_large_document,
    "rollup_maintained": rollup_maintained,
    "request_log_deep": request_log_deep,
    "range_presets": range_presets,
    "import_rejected": import_rejected,
    "ingest_report": ingest_report,
    "rewrite_stored": rewrite_stored,
    "merge_indexed": merge_indexed,
    "sync_rollouts": sync_rollout_logs,
}

_MIDNIGHT = T0 + 20 * DAY - 3600  # in winter an hour before that of UTC
_RANGES = {
    "today": _MIDNIGHT,
    "1d": CLOCK - DAY,
    "7d": _MIDNIGHT - 6 * DAY,
    "14d": _MIDNIGHT - 13 * DAY,
    "30d": _MIDNIGHT - 29 * DAY,
    "90d": _MIDNIGHT - 89 * DAY - 3600,
    "all": 946684800,
    "custom": T0 + DAY,
}


def _fault_sql(name: str) -> str:
    where = FAULTS[name][2].replace("event", "event_id")
    return f"""SELECT '{name}' AS import, COUNT(*) FILTER ({where}) AS invalid,
  CASE WHEN COUNT(*) FILTER ({where}) > 0 THEN 0 ELSE COUNT(*) FILTER (NOT {_STORED}) END AS imported FROM ids"""


ORACLES = {
    "import_large_document": f"{WITH_USAGE} SELECT request_id, model, output_tokens, device_id, true AS is_streaming, created_at FROM u WHERE NOT {_STORED}",
    "rollup_maintained": f"{WITH_EFFECTIVE} {daily_sql('eff')}",
    "request_log_deep": f"""{WITH_EFFECTIVE} SELECT request_id, created_at, model, output_tokens FROM eff
ORDER BY created_at DESC, request_id LIMIT 25 OFFSET 725""",
    "range_presets": f"{WITH_EFFECTIVE} "
    + " UNION ALL ".join(
        f"SELECT '{p}' AS preset, {s} AS range_start, {CLOCK} AS range_end, COUNT(*) AS requests FROM eff WHERE created_at BETWEEN {s} AND {CLOCK}"
        for p, s in _RANGES.items()
    ),
    "import_rejected": f"{WITH_USAGE}, ids AS (SELECT *, CAST(substr(request_id, 4) AS BIGINT) AS event_id FROM u) " + " UNION ALL ".join(map(_fault_sql, FAULTS)),
    "ingest_report": f"""{_GROK}, claude AS (
  SELECT DISTINCT event_id FROM m WHERE event_type <> 'view' AND (wild > 0 OR k > 0)),
offered AS (SELECT COUNT(*) AS n FROM claude)
SELECT 'session_log' AS data_source, n AS imported, 0 AS skipped, (SELECT COUNT(DISTINCT user_id) FROM e) AS files_scanned, 0 AS deferred_files FROM offered
UNION ALL SELECT 'grok_session', COUNT(*), 0, (SELECT COUNT(DISTINCT user_id) FROM e), (SELECT COUNT(*) FROM young) FROM grok""",
    "rewrite_stored": f"""{WITH_USAGE} SELECT request_id, CASE WHEN session_id = 's-5' THEN 'corrected' ELSE model END AS model,
  strftime(make_timestamp(created_at * 1000000), '%Y-%m-%d') AS event_date FROM u""",
    "merge_indexed": f"{WITH_USAGE} SELECT request_id, output_tokens, created_at FROM u WHERE NOT {_STORED}",
    "sync_rollouts": f"""{_FORKED}
SELECT CASE WHEN (owner - owner % 2) % 4 = 0 THEN 0 ELSE 1 END AS wave, {_ROW} FROM deltas
WHERE user_id = owner AND (owner % 2 = 0 OR owner - 1 IN (SELECT user_id FROM e))
UNION ALL SELECT DISTINCT 2, 'waits:00000000-0000-4000-8000-' || lpad(user_id::VARCHAR, 12, '0'), {", ".join(["NULL"] * (len(ROW) - 1))}
FROM e WHERE user_id % 2 = 1 AND user_id - 1 NOT IN (SELECT user_id FROM e)""",
}
