"""Keyed writes over plain Parquet: insert-or-ignore, upsert, update, delete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.times import event_date
from ..schema import SOURCE_CODEX, USAGE_SCHEMA
from ..session import staged


def first_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first in ``order``.

    An aggregate, not a window: duplicates shrink before the shuffle, so a key
    with very many copies (records that all miss their id) costs no hot task.
    Rows that tie in ``order`` are told apart by a hash of all their columns, so the
    choice does not depend on how the rows are dealt out.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by(F.struct(*rest), F.struct(*order, *[F.xxhash64(*rest)][: len(rest)])).alias("_row")
    return df.groupBy(*keys).agg(pick).select(*keys, "_row.*").select(*df.columns)


def first_new(rows: DataFrame, known: DataFrame, key: str, *order: Column) -> DataFrame:
    """``first_per_key`` of the rows whose key is not in ``known``.

    The keys are compared first, without the rows. Those that are known or come again are few in
    most batches and of a size that the planner knows, so all other rows pass without being sorted
    or moved. ``rows`` is read more than once and should be stored, or cheap to make.
    """
    own = rows.select(F.col(key).alias("_key"), F.lit(False).alias("_known"))
    old = known.filter(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.lit(True).alias("_known"))
    seen = own.unionByName(old).groupBy("_key").agg(F.count_if(~F.col("_known")).alias("_n"), F.max("_known").alias("_known"))
    apart = staged(seen.filter("_n > 1 or (_known and _n > 0)").select("_key", "_known"), "seen-keys")
    same = rows[key].eqNullSafe(apart["_key"])
    again = rows.join(apart.filter("not _known"), same, "left_semi")
    return rows.join(apart, same, "left_anti").unionByName(first_per_key(again, [key], *order))


def best_per_key(df: DataFrame, keys: list[str], *rank: Column) -> DataFrame:
    """One row per key, the greatest ``rank``."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by(F.struct(*rest), F.struct(*rank)).alias("_row")
    return df.groupBy(*keys).agg(pick).select(*keys, "_row.*").select(*df.columns)


def new_rows(batch: DataFrame, target: DataFrame, key: str = "request_id", *order: Column) -> DataFrame:
    """Insert-or-ignore: rows of the batch to append, first writer wins."""
    order = order or (F.struct(*[c for c in ("created_at", key) if c in batch.columns]),)
    fresh = batch.join(target.select(key), key, "left_anti").select(*batch.columns)
    return first_per_key(fresh, [key], *order)


def merge_counts(batch: DataFrame, target: DataFrame, key: str = "request_id") -> DataFrame:
    """(imported, skipped) of an insert-or-ignore."""
    sizes = batch.groupBy(key).agg(F.count("*").alias("n"))
    known = target.select(F.col(key), F.lit(True).alias("known"))
    return sizes.join(known, key, "left").agg(
        F.count_if(F.col("known").isNull()).alias("imported"),
        (F.coalesce(F.sum("n"), F.lit(0)) - F.count_if(F.col("known").isNull())).alias("skipped"),
    )


def upsert(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``changes`` replace those of ``current`` with the same key."""
    kept = current.join(changes.select(*keys), keys, "left_anti")
    return kept.select(*current.columns).unionByName(changes.select(*current.columns))


def forget_sessions(usage: DataFrame, files: DataFrame, source: str = SOURCE_CODEX) -> DataFrame:
    """Rows left after a rebuild drops those whose thread file still exists.

    ``files`` has a thread_id column; rows of vanished files cannot be rebuilt
    and stay.
    """
    ids = files.select(F.col("thread_id").alias("session_id")).filter("session_id is not null").distinct()
    doomed = ids.withColumn("data_source", F.lit(source))
    return usage.join(doomed, ["session_id", "data_source"], "left_anti").select(*usage.columns)


def forget_cursors(cursors: DataFrame, files: DataFrame) -> DataFrame:
    """Cursors left after a rebuild: those of files still present are dropped."""
    slashes = lambda c: F.translate(c, "\\", "/")
    present = files.select(slashes(F.col("file_path")).alias("_path")).distinct()
    return (
        cursors.withColumn("_path", slashes(F.col("file_path"))).join(present, "_path", "left_anti").drop("_path")
    )


def stamp_device(df: DataFrame, device_id: str, device_name: str) -> DataFrame:
    """Give rows without a device the local one."""
    blank = F.coalesce(F.col("device_id"), F.lit("")) == ""
    return df.withColumns(
        {
            "device_name": F.when(blank, F.lit(device_name)).otherwise(F.col("device_name")),
            "device_id": F.when(blank, F.lit(device_id)).otherwise(F.col("device_id")),
        }
    )


def write_usage(df: DataFrame, path: str, mode: str = "append") -> None:
    """Append to the fact table, one folder per UTC day.

    Clustering by day first keeps the number of files at one per task and day;
    adaptive execution splits the partitions of a busy day again.
    """
    dated = df.withColumn("event_date", event_date(F.col("created_at")))
    dated.hint("rebalance", "event_date").write.mode(mode).partitionBy("event_date").parquet(path)


def rewrite_days(updated: DataFrame, changed: Column, path: str) -> None:
    """Update by key on the stored table: rewrite only the days that hold a changed row.

    ``updated`` is the whole table after the change, read from ``path``. The rows
    are staged first, so nothing is overwritten while it is still being read.
    """
    # null-safe: rows with a time that no date can hold share a folder
    days = updated.filter(changed).select(F.col("event_date").alias("_day")).distinct()
    names = [f.name for f in USAGE_SCHEMA]
    touched = updated.join(days, F.col("event_date").eqNullSafe(F.col("_day")), "left_semi")
    rows = staged(touched.select(*names, "event_date"), "rewrite")
    writer = rows.hint("rebalance", "event_date").write.mode("overwrite").partitionBy("event_date")
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)
