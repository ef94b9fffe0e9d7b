"""Incremental reading: what was read so far, and what still has to be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.names import base_name
from ..schema import CURSOR_SCHEMA

_ARCHIVE = "archived_sessions"  # fixed value


def inherit_archived(files: DataFrame, cursors: DataFrame) -> DataFrame:
    """Cursors for archived files that have none, taken from the same file name elsewhere.

    The furthest cursor is inherited, the latest modified one among equals.
    """
    folder = F.element_at(F.split("file_path", r"[/\\]"), -2)
    moved = files.filter(folder == _ARCHIVE).join(
        cursors.filter("last_modified <> 0 or last_line_offset <> 0").select("file_path"), "file_path", "left_anti"
    )
    donors = cursors.select(
        base_name(F.col("file_path")).alias("_name"),
        F.col("file_path").alias("_donor"),
        "last_modified",
        "last_line_offset",
        "last_synced_at",
    )
    best = F.max_by(
        F.struct("last_modified", "last_line_offset", "last_synced_at"), F.struct("last_line_offset", "last_modified")
    )
    donated = donors.groupBy("_name").agg(best.alias("_c"))
    return (
        moved.select("file_path", base_name(F.col("file_path")).alias("_name"))
        .join(donated, "_name")
        .select("file_path", "_c.last_modified", "_c.last_line_offset", "_c.last_synced_at")
    )


def changed_files(files: DataFrame, cursors: DataFrame) -> DataFrame:
    """Files modified since their cursor, with the lines already taken (last_line_offset)."""
    known = cursors.select("file_path", "last_modified", "last_line_offset")
    return (
        files.join(known, "file_path", "left")
        .filter(F.col("file_modified_ns") > F.coalesce("last_modified", F.lit(0)))
        .withColumn("last_line_offset", F.coalesce("last_line_offset", F.lit(0)))
        .drop("last_modified")
    )


def unread_lines(lines: DataFrame, cursors: DataFrame) -> DataFrame:
    """Lines of changed files beyond the stored offset."""
    known = cursors.select("file_path", "last_modified", "last_line_offset")
    return (
        lines.join(known, "file_path", "left")
        .filter(
            (F.col("file_modified_ns") > F.coalesce("last_modified", F.lit(0)))
            & (F.col("line_no") > F.coalesce("last_line_offset", F.lit(0)))
        )
        .select(*lines.columns)
    )


def changed_lines(lines: DataFrame, cursors: DataFrame) -> DataFrame:
    """All lines of changed files, for sources that must re-read from the start."""
    known = cursors.select("file_path", F.col("last_modified").alias("_seen"))
    return (
        lines.join(known, "file_path", "left")
        .filter(F.col("file_modified_ns") > F.coalesce("_seen", F.lit(0)))
        .select(*lines.columns)
    )


def line_cursors(lines: DataFrame, synced_at: int) -> DataFrame:
    """Cursor rows after reading the lines to their end."""
    return lines.groupBy("file_path").agg(
        F.max("file_modified_ns").alias("last_modified"),
        F.max("line_no").alias("last_line_offset"),
        F.lit(synced_at).cast("bigint").alias("last_synced_at"),
    )


def beyond_cursor(rows: DataFrame, cursors: DataFrame) -> DataFrame:
    """Rows (file_path, line_no, ...) from lines the cursor has not covered."""
    known = cursors.select("file_path", F.col("last_line_offset").alias("_seen"))
    return (
        rows.join(known, "file_path", "left")
        .filter(F.col("line_no") > F.coalesce("_seen", F.lit(0)))
        .select(*rows.columns)
    )


# --- table sources: one watermark per session --------------------------------


def message_watermarks(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """(session_id, watermark): the later of the session's and its messages' update."""
    latest = messages.groupBy("session_id").agg(F.max("time_updated").alias("_m"))
    return (
        sessions.select(F.col("id").alias("session_id"), "time_updated")
        .join(latest, "session_id", "left")
        .select("session_id", F.greatest("time_updated", F.coalesce("_m", "time_updated")).alias("watermark"))
    )


def usage_watermarks(sessions: DataFrame, usages: DataFrame) -> DataFrame:
    """(session_id, watermark): the later of the last completed request and the session's update."""
    latest = usages.groupBy("session_id").agg(F.max("completed_at").alias("_m"))
    zero = F.lit(0).cast("bigint")
    return (
        sessions.select(F.col("id").alias("session_id"), F.coalesce("time_updated", "time_created", zero).alias("_s"))
        .join(latest, "session_id", "left")
        .select("session_id", F.greatest(F.coalesce("_m", zero), F.col("_s")).alias("watermark"))
    )


def session_cursor_key(prefix: str) -> Column:
    return F.concat(F.lit(prefix + ":"), F.col("session_id"))


def due_sessions(watermarks: DataFrame, cursors: DataFrame, prefix: str) -> DataFrame:
    """Sessions whose watermark moved beyond their cursor."""
    known = cursors.select("file_path", "last_modified")
    return (
        watermarks.withColumn("file_path", session_cursor_key(prefix))
        .join(known, "file_path", "left")
        .filter(F.col("watermark") > F.coalesce("last_modified", F.lit(0)))
        .select("session_id", "watermark")
    )


def session_cursors(due: DataFrame, incomplete: DataFrame, prefix: str, synced_at: int) -> DataFrame:
    """Cursor rows of the due sessions; one with unfinished work stays due."""
    done = due.join(incomplete.select("session_id"), "session_id", "left_anti")
    rows = done.select(
        session_cursor_key(prefix).alias("file_path"),
        F.col("watermark").alias("last_modified"),
        F.lit(0).alias("last_line_offset"),
        F.lit(synced_at).alias("last_synced_at"),
    )
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in CURSOR_SCHEMA])


# --- deferred units -----------------------------------------------------------


def pending_rows(threads: DataFrame, files: DataFrame) -> DataFrame:
    """Table of deferred files with the state they were seen in."""
    held = threads.filter("pending is not null").select("file_path", "parent_id", "pending", "pending_reason")
    return held.join(files.select("file_path", "file_modified_ns", "file_size"), "file_path")


def retry_files(files: DataFrame, pending: DataFrame, index: DataFrame) -> DataFrame:
    """Files worth another try: changed since deferred, retryable, or the parent turned up."""
    held = pending.select(
        "file_path",
        "pending",
        "parent_id",
        F.col("file_modified_ns").alias("_seen_ns"),
        F.col("file_size").alias("_seen_size"),
    )
    present = index.select(F.col("thread_id").alias("parent_id"), F.lit(True).alias("_present"))
    same = (F.col("_seen_ns") == F.col("file_modified_ns")) & (F.col("_seen_size") == F.col("file_size"))
    blocked = same & (
        (F.col("pending") == "stable") | ((F.col("pending") == "missing_parent") & F.col("_present").isNull())
    )
    return (
        files.join(held, "file_path", "left")
        .join(present, "parent_id", "left")
        .filter(~F.coalesce(blocked, F.lit(False)))
        .select(*files.columns)
    )
