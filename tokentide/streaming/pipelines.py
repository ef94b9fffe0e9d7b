"""Continuous ingestion and live figures with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.names import provider_name
from ..functions.tokens import clamp, is_success, real_total, saturating_minus
from ..operators.dedup import bucket_of, drop_known
from ..operators.merge import first_new, first_per_key
from ..operators.ordered import running
from ..schema import DEDUP_WINDOW_SECONDS, OPEN_CACHE_SOURCES, SETTLE_WINDOW_SECONDS, USAGE_SCHEMA, conform
from ..session import staged, staging
from .tables import BETWEEN, BUCKETS, BatchLog, Commits, VersionedTable

def watch(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_batch: int | None = None):
    """A stream of the files landing in a folder."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def start(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, *, poll: str | None = None, mode: str = "append"):
    """Run ``each`` per micro-batch: all available data and stop, or poll forever."""
    writer = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=poll) if poll else writer.trigger(availableNow=True)
    return writer.start()


def id_index(log: BatchLog, buckets: int = BUCKETS) -> VersionedTable:
    """The request ids of a log, in folders by their hash."""
    ids = T.StructType([f for f in log.schema.fields if f.name == "request_id"])
    return VersionedTable(log.spark, f"{log.path}-ids", ids).keyed(["request_id"], buckets=buckets)


def ingest_batch(
    log: BatchLog,
    normalise: Callable[[DataFrame], DataFrame] | None = None,
    buckets: int = BUCKETS,
    complete: Callable[[DataFrame], DataFrame] | None = None,
):
    """Append each request once, whatever is read again; the first writer stays.

    Late records are never dropped: they are compared with the stored ids, of which
    only the hash buckets are read that the batch's own ids fall in, and land in
    their own day. ``buckets`` holds for a new log. A batch that ``normalise`` makes is made once; of
    one that comes as it is the ids are compared first, see ``first_new``. ``complete`` adds columns to
    the rows that are kept (prices), so that they are not made, moved and sorted for repeats.
    """
    ids = id_index(log, buckets)
    order = F.col("created_at"), F.col("provider_id")

    def each(batch: DataFrame, batch_id: int) -> None:
        rows = normalise(batch) if normalise else batch
        rows = rows if complete else conform(rows)
        known = ids.before(batch_id, only=rows)
        with staging(log.spark):
            if normalise:
                fresh = first_per_key(drop_known(rows, known), ["request_id"], *order)
            else:
                fresh = first_new(rows, known, "request_id", *order)
            log.write(batch_id, conform(complete(fresh)) if complete else fresh)
        ids.change(batch_id, log.at(batch_id).select("request_id"))

    return each


def usage_log(spark: SparkSession, path: str) -> BatchLog:
    nullable = T.StructType([T.StructField(f.name, f.dataType) for f in USAGE_SCHEMA])
    return BatchLog(spark, path, nullable, dated=True)


def _settled(pool: DataFrame, now: int, window: int) -> tuple[DataFrame, DataFrame]:
    """(settled, waiting): a young record also holds back the later ones of its file."""
    young = F.lit(now) - F.col("created_at") < window
    barrier = pool.filter(young).groupBy("file_path").agg(F.min("line_no").alias("_barrier"))
    marked = pool.join(barrier, "file_path", "left")
    old = F.coalesce(F.col("line_no") < F.col("_barrier"), F.lit(True))
    return marked.filter(old).drop("_barrier"), marked.filter(~old).drop("_barrier")


DUE = T.StructType([T.StructField("file_path", T.StringType()), T.StructField("due", T.LongType())])


class Settling:
    """Records that wait per file, when each file is due, and what has been emitted, under one commit.

    A file is due when its first waiting record leaves the window; before that nothing of
    it can settle. A step reads the waiting records of files that are due or have new
    records (their hash buckets), and writes the records that came or went. Output, waiting
    records and due times of a step become visible together: a step that dies on the way
    leaves nothing that a reader or a later step sees, and of two steps that started from
    the same state the second starts again.
    """

    def __init__(self, out: BatchLog, pending: VersionedTable, window: int):
        self.spark, self.out, self.window = out.spark, out, window
        self.commits = Commits(self.spark, f"{pending.path}-commits")
        out.note(commits=self.commits.path)
        self.pending = pending.keyed(pending.schema.names, by=["file_path"], commits=self.commits)
        self.due = VersionedTable(self.spark, f"{pending.path}-due", DUE).keyed(["file_path"], commits=self.commits)

    def step(self, now: int, batch: DataFrame | None, parent: int, version: int) -> bool:
        """Write and commit one version; false if another writer came first."""
        names, known = self.out.schema.names, parent if parent >= 0 else None
        files = self.due.at(known).filter(F.col("due") <= now).select("file_path")
        if batch is not None:
            files = files.unionByName(batch.select("file_path"))
        files = staged(files.distinct(), "settle-files")
        waiting = self.pending.at(known, only=files).join(files, "file_path", "left_semi")
        pool = waiting.select(*names, F.lit(True).alias("_was"))
        if batch is not None:
            pool = pool.unionByName(batch.select(*names, F.lit(False).alias("_was")))
        settled, held = _settled(pool, now, self.window)
        self.out.write_version(version, settled)
        came = held.filter(~F.col("_was")).select(*names, F.lit(False).alias("_gone"))
        went = settled.filter("_was").select(*names, F.lit(True).alias("_gone"))
        self.pending.change_version(version, came.unionByName(went).distinct())
        # of the first waiting line's records, the youngest decides
        first = F.min(F.struct(F.col("line_no"), F.coalesce(-F.col("created_at"), F.lit(1 << 62)).alias("age"))).alias("first")
        due = held.groupBy("file_path").agg(first).select("file_path", (self.window - F.col("first.age")).alias("due"))
        timed = files.join(due, "file_path", "left").select("file_path", "due", F.col("due").isNull().alias("_gone"))
        self.due.change_version(version, timed.filter("file_path is not null"))
        if not self.commits.commit(parent, version):
            return False
        self.out.drop_hidden(parent)
        return True


def settle_batch(
    out: BatchLog, pending: VersionedTable, as_of: Callable[[], int], window: int = SETTLE_WINDOW_SECONDS
):
    """Emit records once they are older than the window; younger ones wait.

    Within a group (``file_path``) a waiting record also holds back the later ones.
    A micro-batch only starts when a file lands; ``settle_sweep`` looks at what
    waits between them. Every record is emitted once, also when a batch is repeated or a
    sweep runs beside it, see ``Settling``.
    """
    settling = Settling(out, pending, window)

    def each(batch: DataFrame, batch_id: int) -> None:
        version = batch_id * BETWEEN
        while (parent := settling.commits.head()) < version:
            if settling.step(as_of(), batch, parent, version):
                return
        if not settling.commits.has(version):
            raise ValueError(f"batch {batch_id} comes after version {parent}")

    return each


def settle_sweep(out: BatchLog, pending: VersionedTable, as_of: int, window: int = SETTLE_WINDOW_SECONDS) -> bool:
    """Emit what has settled since, without a new file; run it at every poll.

    It may run beside a batch: the one that commits second is refused. A refused sweep
    (false) has done nothing; the batch has looked at the same files, or the next sweep will.
    """
    settling = Settling(out, pending, window)
    parent = settling.commits.head()
    if (parent + 1) % BETWEEN == 0 and parent > 0:
        raise ValueError("no version is left before the next batch")
    return parent < 0 or settling.step(as_of, None, parent, parent + 1)


def live_buckets(usage: DataFrame, width: str = "1 hour", watermark: str | None = None) -> DataFrame:
    """Requests, tokens and cost per tumbling bucket and provider.

    Without a watermark nothing is late: use update output with ``change_table``, the
    state is one row per bucket and provider. With one, old buckets are closed and released.
    """
    at = F.timestamp_seconds("created_at")
    timed = usage.withColumn("at", at)
    if watermark:
        timed = timed.withWatermark("at", watermark)
    return (
        timed.groupBy(F.window("at", width).alias("w"), provider_name().alias("provider_name"))
        .agg(
            F.count("*").alias("request_count"),
            F.count_if(is_success()).alias("success_count"),
            F.sum(real_total()).alias("total_tokens"),
            F.sum("total_cost_usd").alias("total_cost"),
        )
        .select(
            F.col("w.start").alias("bucket"),
            "provider_name",
            "request_count",
            "success_count",
            "total_tokens",
            "total_cost",
        )
    )


def replace_table(table: VersionedTable):
    """Sink for complete output: each micro-batch is a full new version."""

    def each(batch: DataFrame, batch_id: int) -> None:
        table.write(batch_id, batch)

    return each


def change_table(table: VersionedTable, keys: list[str], buckets: int = 8):
    """Sink for update output: a micro-batch stores the rows that it changes.

    ``buckets`` holds for a new table; few, as figures of time buckets are few.
    """
    table.keyed(keys, buckets=buckets)

    def each(batch: DataFrame, batch_id: int) -> None:
        table.change(batch_id, batch)

    return each


def dedup_live(usage: DataFrame, delay: str = "1 day") -> DataFrame:
    """Drop repeats that arrive within the delay, with bounded state."""
    return usage.withColumn("at", F.timestamp_seconds("created_at")).withWatermark("at", delay).dropDuplicatesWithinWatermark(
        ["request_id"]
    )


def suppress_live(sessions: DataFrame, proxies: DataFrame, delay: str = "1 hour", window: int = DEDUP_WINDOW_SECONDS) -> DataFrame:
    """Session rows without a matching proxy row, decided once both sides are past the window.

    A stream-stream outer join: a session row is released when the watermark
    rules out a later proxy row. Batch reports do not need it, they hide
    duplicates when reading; it serves consumers of the live feed. The time bucket is
    a join key, as in the batch path, so a common token tuple is cut by time.
    """
    app = F.col("app_type")
    folded = F.when(app == "claude-desktop", F.array(app, F.lit("claude"))).otherwise(F.array(app))
    p = (
        proxies.filter(is_success())
        .withColumn("p_app", F.explode(folded))
        .select(
            "p_app",
            F.col("input_tokens").alias("p_in"),
            F.col("output_tokens").alias("p_out"),
            F.col("cache_read_tokens").alias("p_read"),
            F.col("cache_creation_tokens").alias("p_cache"),
            F.lower("model").alias("p_model"),
            F.timestamp_seconds("created_at").alias("p_at"),
            F.explode(F.array(*[bucket_of(F.col("created_at"), window) + d * window for d in (-1, 0, 1)])).alias("p_bucket"),
        )
        .withWatermark("p_at", delay)
    )
    s = sessions.withColumns(
        {"at": F.timestamp_seconds("created_at"), "_bucket": bucket_of(F.col("created_at"), window)}
    ).withWatermark("at", delay)
    gap = F.expr(f"interval {window} seconds")
    open_cache = F.col("data_source").isin(*OPEN_CACHE_SOURCES) & (F.col("cache_creation_tokens") == 0)
    cond = (
        (app == F.col("p_app"))
        & (F.col("_bucket") == F.col("p_bucket"))
        & (F.col("input_tokens") == F.col("p_in"))
        & (F.col("output_tokens") == F.col("p_out"))
        & (F.col("cache_read_tokens") == F.col("p_read"))
        & ((F.col("cache_creation_tokens") == F.col("p_cache")) | open_cache)
        & ((F.lower("model") == F.col("p_model")) | (F.col("p_model") == "unknown") | (F.lower("model") == "unknown"))
        & (F.col("p_at") >= F.col("at") - gap)
        & (F.col("p_at") <= F.col("at") + gap)
    )
    return s.join(p, cond, "left_outer").filter("p_at is null").select(*sessions.columns)


COUNTER_STATE = T.StructType(
    [
        T.StructField("thread_id", T.StringType()),
        T.StructField("line_no", T.LongType()),
        T.StructField("input", T.LongType()),
        T.StructField("cached", T.LongType()),
        T.StructField("output", T.LongType()),
        T.StructField("events", T.LongType()),
    ]
)

DELTA_ROWS = T.StructType(
    [
        T.StructField("thread_id", T.StringType()),
        T.StructField("line_no", T.LongType()),
        T.StructField("event_index", T.LongType()),
        T.StructField("input_tokens", T.LongType()),
        T.StructField("cache_read_tokens", T.LongType()),
        T.StructField("output_tokens", T.LongType()),
    ]
)


def counter_batch(out: BatchLog, state: VersionedTable, chunk_rows: int = 1_000_000, late: BatchLog | None = None):
    """Turn cumulative counters (thread_id, line_no, input, cached, output) into deltas.

    The last counters and the number of emitted events per thread live in a
    table between micro-batches, of which a batch reads the hash buckets of its own
    threads and writes the changed rows. Inside a batch the deltas are running values
    over chunks, so a very busy thread does not sit in one task.

    As with a read offset, lines up to the last one taken are not taken again. With
    ``late``, a table of the batch's columns, those lines are kept there, so that a
    thread whose increments landed out of order can be told from a repeat and rebuilt.
    """

    state.keyed(["thread_id"])

    def each(batch: DataFrame, batch_id: int) -> None:
        known = state.before(batch_id, only=batch)
        counters = F.struct("input", "cached", "output")
        taken = known.select("thread_id", F.col("line_no").alias("_taken"))
        placed = batch.join(taken, "thread_id", "left")
        is_new = F.col("line_no") > F.coalesce("_taken", F.lit(-1))
        fresh = placed.filter(is_new).drop("_taken")
        if late is not None:
            late.write(batch_id, placed.filter(~is_new).drop("_taken"))
        linked = running(
            fresh.select("thread_id", "line_no", "input", "cached", "output"),
            ["thread_id"],
            "line_no",
            last_before={"_prev": counters},
            chunk_rows=chunk_rows,
        )
        seed = known.select(
            "thread_id", F.struct("input", "cached", "output").alias("_seed"), F.col("events").alias("_done")
        )
        linked = linked.join(seed, "thread_id", "left").withColumn("_base", F.coalesce("_prev", "_seed"))

        def step(name: str) -> Column:
            return clamp(saturating_minus(F.col(name), F.col(f"_base.{name}")))

        deltas = linked.select(
            "thread_id",
            "line_no",
            F.coalesce("_done", F.lit(0)).alias("_done"),
            step("input").alias("input_tokens"),
            F.least(step("cached"), step("input")).alias("cache_read_tokens"),
            step("output").alias("output_tokens"),
        ).filter(F.greatest("input_tokens", "cache_read_tokens", "output_tokens") > 0)
        numbered = running(
            deltas, ["thread_id"], "line_no", count={"_n": F.lit(True)}, chunk_rows=chunk_rows
        ).withColumn("event_index", F.col("_n") + F.col("_done"))
        out.write(batch_id, numbered)

        last = fresh.groupBy("thread_id").agg(
            F.max_by(counters, "line_no").alias("_last"), F.max("line_no").alias("line_no")
        )
        emitted = out.at(batch_id).groupBy("thread_id").agg(F.count("*").alias("_n"))
        changed = (
            last.join(emitted, "thread_id", "left")
            .join(known.select("thread_id", F.col("events").alias("_done")), "thread_id", "left")
            .select(
                "thread_id",
                "line_no",
                "_last.*",
                (F.coalesce("_n", F.lit(0)) + F.coalesce("_done", F.lit(0))).alias("events"),
            )
        )
        state.change(batch_id, changed)

    return each
