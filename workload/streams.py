"""Streaming queries over increments of the derived usage, each drained to its end."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from tokentide.operators.dedup import effective_usage
from tokentide.operators.pricing import price_usage, seed_prices
from tokentide.schema import READ_DEDUP_SOURCES, SESSION_SOURCES
from tokentide.session import new_path
from tokentide.sources.opencode import opencode_usage
from tokentide.streaming import pipelines as S
from tokentide.streaming.tables import BatchLog, VersionedTable

from .logs import _OPENCODE, NOW, opencode_tables
from .views import T0, WITH_EFFECTIVE, WITH_USAGE, big, events, money, spread, usage

DAY = 86400
AS_OF = T0 + 29 * DAY
LATER = AS_OF + DAY // 2
CUT = T0 + 12 * DAY


def increments(df, order, cuts):
    """A frame cut at the given values of ``order``."""
    bounds = [None, *cuts, None]
    for low, high in zip(bounds, bounds[1:]):
        part = df
        if low is not None:
            part = part.filter(F.col(order) >= low)
        if high is not None:
            part = part.filter(F.col(order) < high)
        yield part


def feed(parts, query, each, mode="append"):
    """Land one increment after the other; each poll takes all files that are new."""
    path = checkpoint = None
    for part in parts:
        spark = part.sparkSession
        path = path or new_path(spark, "landed")
        checkpoint = checkpoint or new_path(spark, "checkpoint")
        part.write.mode("append").parquet(path)
        stream = query(S.watch(spark, path, part.schema))
        S.start(stream, each, checkpoint, mode=mode).awaitTermination()


def as_is(stream):
    return stream


def stream_dedup(spark, sf):
    """Early records are delivered again in a last increment; one of each is stored."""
    rows = usage(spark, spread(spark, sf, "events", "event_id"))
    again = rows.filter(F.col("created_at") < CUT)
    log = S.usage_log(spark, new_path(spark, "fact"))
    feed([*increments(rows, "created_at", [CUT]), again], as_is, S.ingest_batch(log))
    return log.read().groupBy("data_source").agg(
        F.count("*").alias("records"), F.countDistinct("request_id").alias("requests")
    )


def stream_suppression(spark, sf):
    """Session and proxy records arrive in any order; reading hides the duplicates."""
    rows = usage(spark, spread(spark, sf, "events", "event_id"))
    log = S.usage_log(spark, new_path(spark, "fact"))
    feed(increments(rows, "created_at", [CUT]), as_is, S.ingest_batch(log))
    return effective_usage(log.read()).groupBy("data_source").agg(F.count("*").alias("records"))


def stream_settled(spark, sf):
    """Turns are emitted once settled; a young one holds back the rest of its session.

    Then the clock moves on and no file lands: a sweep emits what has settled since. The
    state is read by a fresh object, as after a restart.
    """
    rows = usage(spark, sf).filter(F.col("data_source").isin(*SESSION_SOURCES))
    turns = rows.select(
        F.col("session_id").alias("file_path"),
        F.substring("request_id", 4, 20).cast("bigint").alias("line_no"),
        "request_id",
        "created_at",
    )
    nullable = T.StructType([T.StructField(f.name, f.dataType) for f in turns.schema])
    out = BatchLog(spark, new_path(spark, "settled"), nullable)
    folder = new_path(spark, "pending")
    feed(increments(turns, "created_at", [CUT]), as_is, S.settle_batch(out, VersionedTable(spark, folder, nullable), lambda: AS_OF))
    S.settle_sweep(out, VersionedTable(spark, folder, nullable), LATER)
    waiting = VersionedTable(spark, folder, nullable).latest().select("request_id", F.lit("waiting").alias("state"))
    return out.read().select("request_id", F.lit("emitted").alias("state")).unionByName(waiting)


def stream_source(spark, sf):
    """A tool's message table as a stream: its adapter runs in each micro-batch."""
    messages = opencode_tables(spark, spread(spark, sf, "events", "event_id"))[1]
    log = S.usage_log(spark, new_path(spark, "fact"))
    prices = seed_prices(spark)
    each = S.ingest_batch(log, lambda batch: opencode_usage(batch, NOW), complete=lambda rows: price_usage(rows, prices))
    feed([*increments(messages, "time_created", [CUT * 1000]), messages], as_is, each)
    return log.read().select("request_id", "model", "input_tokens", "output_tokens", "created_at")


def live_rows(spark, sf):
    """The live rule over all session sources it is for, and proxy; two records at the end let the watermark pass."""
    rows = usage(spark, sf).filter(F.col("data_source").isin(*READ_DEDUP_SOURCES, "proxy"))
    last = rows.groupBy((F.col("data_source") == "proxy").alias("side")).agg(F.min("request_id").alias("request_id"))
    end = rows.join(last, "request_id", "left_semi").withColumns(
        {"request_id": F.lit("end"), "created_at": F.lit(T0 + 400 * DAY).cast("bigint")}
    )
    path, sink = new_path(spark, "landed"), new_path(spark, "live")
    rows.unionByName(end).write.parquet(path)
    stream = lambda: S.watch(spark, path, rows.schema)
    live = S.suppress_live(stream().filter("data_source <> 'proxy'"), stream().filter("data_source = 'proxy'"))
    writer = live.writeStream.format("parquet").option("checkpointLocation", new_path(spark, "checkpoint"))
    writer.trigger(availableNow=True).start(sink).awaitTermination()
    return spark.read.schema(rows.schema).parquet(sink).filter("request_id <> 'end'")


def stream_live_suppression(spark, sf):
    """All session sources that the rule is for, next to the proxy's records."""
    return live_rows(spark, sf).select("request_id", "data_source", "created_at")


def stream_buckets(spark, sf):
    rows = usage(spark, sf)
    schema = S.live_buckets(rows, "1 hour").schema
    table = VersionedTable(spark, new_path(spark, "buckets"), schema)
    parts = increments(rows, "created_at", [CUT])
    feed(parts, lambda stream: S.live_buckets(stream, "1 hour"), S.change_table(table, ["bucket", "provider_name"]), mode="update")
    return table.latest().select(
        F.date_format("bucket", "yyyy-MM-dd HH:mm:ss").alias("bucket"),
        "provider_name",
        "request_count",
        "success_count",
        "total_tokens",
        F.round("total_cost", 6).cast("double").alias("total_cost"),
    )


def stream_counter_state(spark, sf):
    """Cumulative counters per user, in increments; deltas carry over between them."""
    e = events(spark, sf).select(
        F.concat(F.lit("u-"), "user_id").alias("thread_id"),
        F.col("event_id").alias("line_no"),
        (F.col("event_id") * 3 + 100).alias("input"),
        F.col("event_id").alias("cached"),
        (F.col("event_id") * 2 + F.col("k")).alias("output"),
    )
    middle = e.agg(F.avg("line_no")).first()[0]
    out = BatchLog(spark, new_path(spark, "deltas"), S.DELTA_ROWS)
    state = VersionedTable(spark, new_path(spark, "state"), S.COUNTER_STATE)
    feed(increments(e, "line_no", [middle]), as_is, S.counter_batch(out, state))
    return out.read()


QUERIES = {
    "stream_dedup": stream_dedup,
    "stream_suppression": stream_suppression,
    "stream_settled": stream_settled,
    "stream_source": stream_source,
    "stream_live_suppression": stream_live_suppression,
    "stream_buckets": stream_buckets,
    "stream_counter_state": stream_counter_state,
}

ORACLES = {
    "stream_dedup": f"""{WITH_USAGE} SELECT data_source, COUNT(*) AS records, COUNT(DISTINCT request_id) AS requests
FROM u GROUP BY data_source""",
    "stream_suppression": f"{WITH_EFFECTIVE} SELECT data_source, COUNT(*) AS records FROM eff GROUP BY data_source",
    "stream_source": f"{_OPENCODE} SELECT request_id, model, input_tokens, output_tokens, created_at FROM opencode",
    "stream_live_suppression": f"""{WITH_EFFECTIVE} SELECT request_id, data_source, created_at FROM eff
WHERE data_source IN ({', '.join(f"'{s}'" for s in READ_DEDUP_SOURCES)})""",
    "stream_settled": f"""{WITH_USAGE}, s AS (
  SELECT request_id, session_id, created_at, CAST(substr(request_id, 4) AS BIGINT) AS line_no FROM u
  WHERE data_source <> 'proxy'),
b AS (SELECT session_id, MIN(line_no) AS barrier FROM s WHERE {LATER} - created_at < 600 GROUP BY 1)
SELECT request_id, CASE WHEN barrier IS NULL OR line_no < barrier THEN 'emitted' ELSE 'waiting' END AS state
FROM s LEFT JOIN b USING (session_id)""",
    "stream_buckets": f"""{WITH_USAGE}
SELECT strftime(make_timestamp(created_at * 1000000), '%Y-%m-%d %H:00:00') AS bucket, provider_name,
  COUNT(*) AS request_count, {big('SUM(CASE WHEN status_code BETWEEN 200 AND 299 THEN 1 ELSE 0 END)')} AS success_count,
  {big('SUM(fresh + output_tokens + cache_read_tokens + cache_creation_tokens)')} AS total_tokens,
  {money('SUM(total_cost_usd)')} AS total_cost FROM u GROUP BY 1, 2""",
    "stream_counter_state": """WITH e AS (
  SELECT event_id, user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events),
s AS (SELECT *, LAG(event_id) OVER w AS pe, LAG(k) OVER w AS pk FROM e
      WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
d AS (SELECT 'u-' || user_id AS thread_id, event_id AS line_no,
        CASE WHEN pe IS NULL THEN event_id * 3 + 100 ELSE (event_id - pe) * 3 END AS input_tokens,
        CASE WHEN pe IS NULL THEN event_id ELSE event_id - pe END AS cache_read_tokens,
        CASE WHEN pe IS NULL THEN event_id * 2 + k ELSE GREATEST((event_id - pe) * 2 + k - pk, 0) END AS output_tokens
      FROM s)
SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY line_no) AS event_index FROM d
WHERE input_tokens > 0 OR cache_read_tokens > 0 OR output_tokens > 0""",
}
