"""From normalised session rows to new fact rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.cursors import beyond_cursor
from ..operators.dedup import drop_near_activity, ingest_dedup
from ..operators.merge import first_per_key, stamp_device
from ..operators.ordered import CHUNK_ROWS
from ..operators.pricing import price_usage
from ..operators.replay import drop_replayed, parent_timeline, replay_prefix, resolve_parents
from ..schema import SOURCE_GROK, conform
from ..session import staged
from ..sources.rollouts import classify_threads, rollout_records, rollout_usage, token_events


def finish(
    rows: DataFrame,
    fact: DataFrame,
    prices: DataFrame,
    *,
    device_id: str = "",
    device_name: str = "",
) -> DataFrame:
    """Rows to append: not known, not seen by the proxy, priced, one per request id."""
    fresh = ingest_dedup(rows, fact)
    chosen = first_per_key(fresh, ["request_id"], F.col("file_path"), F.col("line_no"))
    return stamp_device(conform(price_usage(chosen, prices)), device_id, device_name)


def finish_grok(rows: DataFrame, fact: DataFrame, prices: DataFrame, **device: str) -> DataFrame:
    """As ``finish``; any proxy activity of the app nearby hides the row first."""
    return finish(drop_near_activity(rows, fact), fact, prices, **device)


def rollout_tables(lines: DataFrame, chunk_rows: int = CHUNK_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Staged (records, threads, events) of rollout logs.

    Logs are parsed once into a narrow table that all later steps read.
    """
    records = staged(rollout_records(lines), "records")
    threads = staged(resolve_parents(classify_threads(records), records, chunk_rows), "threads")
    return records, threads, staged(token_events(records, chunk_rows), "events")


def rollout_rows(
    lines: DataFrame,
    ingest_ts: int,
    *,
    cursors: DataFrame | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """(usage rows, threads) of rollout logs, replayed history removed.

    Deltas need the log from its start, so cursors only limit what is emitted.
    """
    records, threads, events = rollout_tables(lines, chunk_rows)
    prefixes = replay_prefix(threads, events, parent_timeline(records), chunk_rows)
    rows = rollout_usage(drop_replayed(events, threads, prefixes), ingest_ts)
    if cursors is not None:
        rows = beyond_cursor(rows, cursors)
    return rows, threads


def ingest_all(
    spark: SparkSession,
    builders: dict[str, Callable[[], DataFrame]],
    fact: DataFrame,
    prices: DataFrame,
    *,
    scans: dict[str, DataFrame] | None = None,
    **device: str,
) -> tuple[DataFrame, DataFrame]:
    """(new fact rows, metrics) over all sources, given name -> rows builders.

    Every source is read and staged on its own: one that fails is reported in the
    metrics and does not stop the others. Request ids carry their source, so
    sources cannot collide. ``scans`` names the files each source looked at, as
    (file_path, deferred), for the file counts of the metrics.
    """
    rows = conform(fact).limit(0)
    metrics = spark.createDataFrame([], METRICS)
    errors: list[tuple[str, str]] = []

    def tally(df: DataFrame, source: str, **counts) -> DataFrame:
        sizes = df.agg(*[c.alias(n) for n, c in counts.items()])
        return metrics.unionByName(sizes.withColumn("data_source", F.lit(source)), allowMissingColumns=True)

    for name, build in builders.items():
        try:
            finishing = finish_grok if name == SOURCE_GROK else finish
            offered = staged(build(), f"rows-{name}")
            fresh = staged(finishing(offered, fact, prices, **device), f"fresh-{name}")
        except Exception as error:  # noqa: BLE001 - isolation is the feature
            errors.append((name, f"{type(error).__name__}: {error}"))
            continue
        metrics = tally(offered, name, offered=F.count("*"))
        metrics = tally(fresh, name, imported=F.count("*"))
        if scans and name in scans:
            metrics = tally(scans[name], name, files_scanned=F.count("*"), deferred_files=F.count_if("deferred"))
        rows = rows.unionByName(fresh)
    failed = spark.createDataFrame(errors, "data_source string, error string")
    counted = metrics.unionByName(failed, allowMissingColumns=True).groupBy("data_source")
    amounts = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("offered", "imported", "files_scanned", "deferred_files")]
    report = counted.agg(*amounts, F.max("error").alias("error")).select(
        "data_source",
        "imported",
        (F.col("offered") - F.col("imported")).alias("skipped"),
        "files_scanned",
        "deferred_files",
        F.lit(0).cast("bigint").alias("suspected_duplicates"),
        "error",
    )
    return rows, report


METRICS = """data_source string, offered bigint, imported bigint, files_scanned bigint, deferred_files bigint,
error string"""
