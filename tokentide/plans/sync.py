"""One incremental pass per source: (usage rows, cursor changes).

The caller finishes and writes the rows, then upserts the cursor changes, in that
order: a pass that dies in between is repeated and finds its rows already known.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.names import thread_id
from ..operators import cursors as C
from ..operators.merge import upsert
from ..operators.ordered import CHUNK_ROWS
from ..operators.replay import drop_replayed, parent_timeline, replay_prefix
from ..schema import CURSOR_SCHEMA
from ..session import staged
from ..sources.claude import claude_usage
from ..sources.gemini import gemini_usage
from ..sources.grok import deferred_files, grok_events, grok_usage, settled_events
from ..sources.opencode import opencode_incomplete, opencode_usage
from ..sources.rollouts import classify_threads, rollout_records, rollout_usage
from ..sources.zcode import zcode_incomplete, zcode_usage
from .ingest import rollout_tables

Pass = tuple[DataFrame, DataFrame]


def _cursor_rows(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType) for f in CURSOR_SCHEMA])


def sync_files(
    spark: SparkSession,
    files: DataFrame,
    cursors: DataFrame,
    read: Callable[[SparkSession, list[str]], DataFrame] | Callable[[SparkSession, DataFrame], DataFrame],
    sync: Callable[[DataFrame, DataFrame, int], tuple],
    now: int,
    *,
    by_table: bool = False,
) -> tuple | None:
    """A pass over the files that changed since their cursor: no other file is opened.

    ``files`` is the list of files (sources.lines.list_files), ``read`` reads paths, or with
    ``by_table`` a table of the changed files (sources.lines.read_files), and
    ``sync`` is one of the passes below, which gets the cursors of those files only.
    None when nothing changed. Rollout logs need the parents of changed logs too, and
    so take ``sync_rollout_files`` instead.
    """
    changed = staged(C.changed_files(files, cursors).select(*files.columns), "changed-files")
    if changed.isEmpty():
        return None
    known = staged(cursors.join(changed.select("file_path"), "file_path", "left_semi"), "known-cursors")
    return sync(_opened(spark, changed, read, by_table), known, now)


def _opened(spark, files: DataFrame, read, by_table: bool) -> DataFrame:
    """The lines of a table of files, by a reader of such tables or one of paths."""
    return read(spark, files if by_table else sorted(r.file_path for r in files.select("file_path").collect()))


def rollout_paths(
    spark: SparkSession,
    files: DataFrame,
    cursors: DataFrame,
    pending: DataFrame,
    read: Callable[[SparkSession, list[str]], DataFrame],
) -> list[str]:
    """Rollout logs to open: changed ones that are worth another try, and their parents.

    A deferred log stays closed until it changes or its parent turns up. The parents
    are found from the first lines of the changed logs; archived logs take over the
    cursor of the place they came from.
    """
    due, _, parents, _ = _due_rollouts(spark, files, cursors, pending, read)
    return sorted(r.file_path for t in (due, parents) if t is not None for r in t.select("file_path").collect())


def _forks(lines: DataFrame) -> DataFrame:
    """(file_path, parent_id) of logs by their first meta line; the other lines are not parsed."""
    heads = lines.filter(F.col("value").contains('"session_meta"'))
    return classify_threads(rollout_records(heads)).select("file_path", "parent_id").filter("parent_id is not null")


def _due_rollouts(spark, files, cursors, pending, read, by_table=False) -> tuple[DataFrame | None, ...]:
    """(logs to open, their lines, the parents among the other logs, forks): see ``rollout_paths``."""
    known = upsert(cursors, C.inherit_archived(files, cursors), ["file_path"])
    index = files.select(thread_id(F.col("file_name")).alias("thread_id"), "file_path").filter("thread_id is not null")
    worth = staged(C.retry_files(files, pending, index.select("thread_id").distinct()), "worth-files")
    again = worth.join(pending.select("file_path"), "file_path", "left_semi").select("file_path")
    due = C.changed_files(worth, known).select("file_path").union(again).distinct()
    due = staged(worth.join(due, "file_path", "left_semi"), "due-files")
    if due.isEmpty():
        return None, None, None, None
    lines = _opened(spark, due, read, by_table)
    forks = staged(_forks(lines), "forks")
    found = index.join(forks.select(F.col("parent_id").alias("thread_id")), "thread_id", "left_semi").select("file_path")
    others = found.join(due.select("file_path"), "file_path", "left_anti")
    return due, lines, staged(files.join(others, "file_path", "left_semi"), "parent-files"), forks


def sync_claude(lines: DataFrame, cursors: DataFrame, now: int) -> Pass:
    """Only lines beyond the offset are read."""
    rows = claude_usage(C.unread_lines(lines, cursors), now)
    return rows, _cursor_rows(C.line_cursors(C.changed_lines(lines, cursors), now))


def sync_gemini(documents: DataFrame, cursors: DataFrame, now: int) -> Pass:
    """Changed documents are read whole; known messages are dropped when finishing."""
    changed = C.changed_files(documents, cursors)
    done = changed.select(
        "file_path",
        F.col("file_modified_ns").alias("last_modified"),
        F.lit(0).alias("last_line_offset"),
        F.lit(now).alias("last_synced_at"),
    )
    return gemini_usage(changed, now), _cursor_rows(done)


def sync_grok(lines: DataFrame, cursors: DataFrame, now: int, chunk_rows: int = CHUNK_ROWS) -> Pass:
    """Changed files are read whole; one with a young turn keeps its cursor."""
    changed = C.changed_lines(lines, cursors)
    events = staged(grok_events(changed, chunk_rows), "grok")
    done = C.line_cursors(changed, now).join(deferred_files(events, now), "file_path", "left_anti")
    return grok_usage(settled_events(events, now)), _cursor_rows(done)


def sync_rollouts(
    lines: DataFrame, cursors: DataFrame, now: int, chunk_rows: int = CHUNK_ROWS, forks: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, cursor changes, threads): changed logs, plus the parents they were forked from.

    Archived files take over the cursor of the place they came from. A deferred
    log with billable events keeps its cursor and is tried again. What is read is decided by
    file: lines are joined with nothing but the files that are left out, if there are any.
    ``forks``, (file_path, parent_id) of all logs, saves looking for them in the lines.
    """
    files = staged(
        lines.groupBy("file_path", "file_name").agg(F.max("file_modified_ns").alias("file_modified_ns"), F.max("line_no").alias("line_no")),
        "rollout-files",
    )
    moved = staged(C.inherit_archived(files, cursors), "moved")
    known = staged(upsert(cursors, moved, ["file_path"]), "cursors")
    changed = staged(C.changed_lines(files, known), "changed-files")

    forks = _forks(lines) if forks is None else forks
    forked = forks.join(changed.select("file_path"), "file_path", "left_semi").select(F.col("parent_id").alias("thread_id"))
    tagged = files.withColumn("thread_id", F.lower(F.regexp_extract("file_name", r"([0-9a-fA-F-]{36})\.jsonl$", 1)))
    parents = tagged.join(forked, "thread_id", "left_semi").select("file_path")
    wanted = changed.select("file_path").unionByName(parents)
    unwanted = staged(files.join(wanted, "file_path", "left_anti").select("file_path"), "unwanted")
    own = lines if unwanted.isEmpty() else lines.filter("file_path is not null").join(unwanted, "file_path", "left_anti")
    records, threads, events = rollout_tables(own, chunk_rows)

    prefixes = replay_prefix(threads, events, parent_timeline(records), chunk_rows)
    fresh = changed.select("file_path")
    rows = rollout_usage(drop_replayed(events, threads, prefixes), now).join(fresh, "file_path", "left_semi")

    billable = events.filter("event_index is not null").select("file_path").distinct()
    held = threads.filter("pending is not null").join(billable, "file_path", "left_semi")
    done = C.line_cursors(changed, now).join(held.select("file_path"), "file_path", "left_anti")
    inherited = moved.join(done.select("file_path"), "file_path", "left_anti")
    changes = _cursor_rows(done).unionByName(_cursor_rows(inherited))
    return C.beyond_cursor(rows, known), changes, threads.join(fresh, "file_path", "left_semi")


PENDING = "file_path string, parent_id string, pending string, pending_reason string, file_modified_ns bigint, file_size bigint"


def sync_rollout_files(
    spark: SparkSession,
    files: DataFrame,
    cursors: DataFrame,
    pending: DataFrame,
    read: Callable[[SparkSession, list[str]], DataFrame] | Callable[[SparkSession, DataFrame], DataFrame],
    now: int,
    *,
    by_table: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """(rows, cursor changes, the pending table after the pass) of rollout logs that are due; None if none are.

    ``pending`` (columns as in ``PENDING``) is what the pass before has left: a log
    that it deferred is opened again when it has changed or its parent has turned up.
    Each log is read once: the lines in which parents are looked for are those of the pass.
    ``read`` and ``by_table`` are as in ``sync_files``.
    """
    due, lines, parents, forks = _due_rollouts(spark, files, cursors, pending, read, by_table)
    if due is None:
        return None
    if not parents.isEmpty():
        more = _opened(spark, parents, read, by_table)
        lines, forks = lines.unionByName(more), forks.unionByName(staged(_forks(more), "forks"))
    rows, changes, threads = sync_rollouts(lines, cursors, now, forks=forks)
    tried = staged(threads, "rollout-threads")
    held = C.pending_rows(tried, files)
    left = pending.join(tried.select("file_path"), "file_path", "left_anti")
    return rows, changes, left.select(*held.columns).unionByName(held)


def _sync_sessions(table, marks, incomplete, read, cursors, prefix, now) -> Pass:
    due = C.due_sessions(marks, cursors, prefix)
    rows = read(table.join(due.select("session_id"), "session_id", "left_semi"), now)
    return rows, C.session_cursors(due, incomplete, prefix, now)


def sync_opencode(sessions: DataFrame, messages: DataFrame, cursors: DataFrame, prefix: str, now: int) -> Pass:
    """Sessions updated since their watermark; one with an unfinished message stays due."""
    marks = C.message_watermarks(sessions, messages)
    return _sync_sessions(messages, marks, opencode_incomplete(messages), opencode_usage, cursors, prefix, now)


def sync_zcode(sessions: DataFrame, usages: DataFrame, cursors: DataFrame, prefix: str, now: int) -> Pass:
    marks = C.usage_watermarks(sessions, usages)
    return _sync_sessions(usages, marks, zcode_incomplete(usages), zcode_usage, cursors, prefix, now)
