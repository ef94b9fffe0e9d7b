"""Prices, merging, cursors, transfer and streams."""

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tokentide.operators import cursors as C, merge as M, pricing as P, transfer as X
from tokentide.operators.dedup import effective_usage
from tokentide.operators.filters import UsageQuery
from tokentide.operators.insights import trend_chart, trend_delta, insight_feed
from tokentide.operators import analytics as A
from tokentide.plans.refresh import refresh_and_recost
from tokentide.plans.report import usage_report
from tokentide.sources.landed import price_catalog
from tokentide.streaming import pipelines as S
from tokentide.streaming.tables import BatchLog, VersionedTable

T = 1_700_000_000


def test_price_lookup(make_usage, spark):
    df = make_usage([{"model": m} for m in ("GLM-5.2", "gpt-5-20250807", "claude-opus-4-20250514", "openai/gpt-5.4", "x")])
    got = {r.model: r.priced_as for r in P.with_prices(df, P.seed_prices(spark)).collect()}
    assert got == {
        "GLM-5.2": "glm-5.2",
        "gpt-5-20250807": "gpt-5",
        "claude-opus-4-20250514": "claude-opus-4-20250514",
        "openai/gpt-5.4": None,
        "x": None,
    }
    loose = {r.model: r.priced_as for r in P.with_prices(df, P.seed_prices(spark), normalized=True).collect()}
    assert loose["openai/gpt-5.4"] == "gpt-5.4"


def test_recost(make_usage, spark):
    df = make_usage(
        [
            dict(model="gpt-5", input_tokens=1_000_000, app_type="opencode", data_source="opencode_session", total_cost_usd="9"),
            dict(model="gpt-5", input_tokens=1_000_000),
            dict(model="nope", total_cost_usd="3"),
            dict(model="gpt-5", input_tokens=1_000_000, data_source="proxy", total_cost_usd="7"),
        ]
    )
    def costs(**kw):
        out = P.recost(df, P.seed_prices(spark), **kw).orderBy("request_id").collect()
        return [(float(r.total_cost_usd), r.recost_status) for r in out]

    assert costs() == [(1.25, "updated"), (1.25, "updated"), (3.0, "skipped"), (7.0, None)]
    assert costs(only_zero=True) == [(9.0, None), (1.25, "updated"), (3.0, None), (7.0, None)]
    assert costs(preserve_reported=True)[0] == (9.0, None)


def catalog(spark, *entries):
    doc = {"data": [{"id": i, "name": n, "pricing": p} for i, n, p in entries]}
    return price_catalog(spark.createDataFrame([(json.dumps(doc),)], "value string"))


def test_refresh(make_usage, spark):
    prices = P.seed_prices(spark).filter("model_id in ('gpt-5.4', 'glm-5', 'claude-opus-4-20250514')")
    cat = catalog(
        spark,
        ("openai/gpt-5.4", "GPT", {"prompt": "0.0000025", "completion": "0.000015", "input_cache_read": "0.0000003"}),
        ("lab/future-model", "Future", {"prompt": "0.000001", "completion": "0.000002", "cache_read": "0.0000001"}),
        ("lab/unrelated", "No", {"prompt": "1", "completion": "1"}),
        ("a/glm-5", "one", {"prompt": "0.1", "completion": "1"}),
        ("b/glm.5", "two", {"prompt": "0.1", "completion": "1"}),
        ("x/claude-opus-4", "Opus", {"prompt": "0.000001", "completion": "bad"}),
        ("x/claude-opus-4:free", "Opus", {"prompt": "0", "completion": "0"}),
    )
    usage = make_usage([dict(model="FUTURE-MODEL", input_tokens=1000), dict(model=" "), dict(model="gpt_5.4-20250101")])
    out = refresh_and_recost(usage, prices, cat, 77)
    rows = {r.model_id: r for r in out["prices"].collect()}
    assert set(rows) == {"gpt-5.4", "glm-5", "claude-opus-4-20250514", "FUTURE-MODEL"}
    new = rows["FUTURE-MODEL"]
    assert [float(new[c]) for c in P.PRICE_COLUMNS] == [1, 2, 0.1, 0]
    assert (new.display_name, new.price_source, new.price_fetched_at) == ("Future", "OpenRouter live", 77)
    assert [float(rows["gpt-5.4"][c]) for c in P.PRICE_COLUMNS] == [2.5, 15, 0.3, 0]
    assert rows["glm-5"].price_source == rows["claude-opus-4-20250514"].price_source == "Built-in fallback"
    status = out["status"].first()
    assert (status.catalog_models, status.updated_models, status.added_models) == (7, 1, 1)
    assert out["metrics"].first().updated == 1
    assert P.price_cache_summary(out["prices"]).first().asDict() == {
        "model_count": 4, "live_models": 2, "fallback_models": 2, "latest_fetched_at": 77,
    }
    assert P.add_seed_prices(prices).count() == 46


def test_insert_or_ignore(make_usage):
    target = make_usage([{"request_id": "a"}])
    batch = make_usage([{"request_id": i, "output_tokens": n} for n, i in enumerate("abbc")])
    fresh = M.new_rows(batch, target, "request_id", F.col("output_tokens"))
    assert {(r.request_id, r.output_tokens) for r in fresh.collect()} == {("b", 1), ("c", 3)}
    assert M.merge_counts(batch, target).first().asDict() == {"imported": 2, "skipped": 2}
    assert M.new_rows(batch, target.unionByName(fresh)).count() == 0


def test_rebuild(make_usage, spark):
    df = make_usage(
        [
            dict(session_id="a", data_source="codex_session"),
            dict(session_id="b", data_source="codex_session"),
            dict(session_id="a", data_source="session_log"),
            dict(session_id=None, data_source="codex_session"),
        ]
    )
    files = spark.createDataFrame([("a", "h\\s\\a"), (None, "q")], "thread_id string, file_path string")
    assert {r.request_id for r in M.forget_sessions(df, files).collect()} == {"r1", "r2", "r3"}
    cursors = spark.createDataFrame([("h/s/a",), ("z",)], "file_path string")
    assert [r.file_path for r in M.forget_cursors(cursors, files).collect()] == ["z"]


CURSOR = "file_path string, last_modified bigint, last_line_offset bigint, last_synced_at bigint"
FILE = "file_path string, file_modified_ns bigint, file_size bigint"


def test_archived_files_inherit(spark):
    files = spark.createDataFrame(
        [("/h/archived_sessions/r.jsonl", 50, 1), ("/h/archived_sessions/own.jsonl", 50, 1), ("/h/sessions/n.jsonl", 50, 1)], FILE
    )
    cursors = spark.createDataFrame(
        [("/h/s/r.jsonl", 10, 7, 1), ("C:\\s\\r.jsonl", 20, 7, 1), ("/h/q/r.jsonl", 99, 3, 1),
         ("/h/archived_sessions/own.jsonl", 50, 2, 1), ("/h/s/n.jsonl", 1, 1, 1)],
        CURSOR,
    )
    got = C.inherit_archived(files, cursors)
    assert [(r.file_path, r.last_modified, r.last_line_offset) for r in got.collect()] == [
        ("/h/archived_sessions/r.jsonl", 20, 7)
    ]
    known = M.upsert(cursors, got, ["file_path"])
    todo = {r.file_path: r.last_line_offset for r in C.changed_files(files, known).collect()}
    assert todo == {"/h/archived_sessions/r.jsonl": 7, "/h/sessions/n.jsonl": 0}


def test_deferred_files_are_retried(spark):
    files = spark.createDataFrame([(n, 5, 5) for n in "abcde"] + [("f", 6, 5)], FILE)
    pending = spark.createDataFrame(
        [("a", 5, 5, "stable", None), ("b", 5, 5, "retryable", "p"), ("c", 5, 5, "missing_parent", "p"),
         ("d", 5, 5, "missing_parent", "q"), ("f", 5, 5, "stable", None)],
        FILE + ", pending string, parent_id string",
    )
    index = spark.createDataFrame([("q",)], "thread_id string")
    assert {r.file_path for r in C.retry_files(files, pending, index).collect()} == {"b", "d", "e", "f"}


def test_export_import(make_usage, spark, tmp_path):
    df = make_usage(
        [
            dict(request_id="a", created_at=T + 1, total_cost_usd="0.123456789", is_streaming=False, device_id="x"),
            dict(request_id="b", created_at=T, error_message='quote " and \n line'),
        ]
    )
    path = str(tmp_path / "x")
    assert X.export_usage(df, path, "dev-a", "工作电脑", 5).first().recordCount == 2
    back = X.read_export(spark, path)
    empty = df.limit(0)
    rows = {r.request_id: r for r in X.import_usage(back, empty).collect()}
    assert rows["a"].total_cost_usd == Decimal("0.123456789") and rows["a"].is_streaming is False
    assert (rows["b"].device_id, rows["b"].device_name, rows["a"].device_id) == ("dev-a", "工作电脑", "x")
    assert rows["b"].error_message == 'quote " and \n line'
    assert X.import_summary(back, empty).first().asDict() == {"imported": 2, "skipped": 0, "device_count": 2}
    assert X.import_summary(back, df).first().asDict() == {"imported": 0, "skipped": 2, "device_count": 2}


def test_import_documents(make_usage, spark):
    record = {"requestId": "q", "providerId": "_s", "appType": "codex", "model": "m", "inputTokens": 100,
              "outputTokens": 1, "createdAt": T, "statusCode": 200, "isStreaming": 1, "totalCostUsd": "0.5", "deviceId": " "}

    def load(version=1, **change):
        doc = {"schemaVersion": version, "exportedAt": 1, "sourceDevice": {"id": "d", "name": "D"},
               "records": [record, {**record, "requestId": "r", **change}]}
        return X.read_documents(spark.createDataFrame([(json.dumps(doc),)], "value string"), max_records=5)

    fact = make_usage([{"request_id": "r"}])
    got = X.import_usage(load(), fact).collect()
    assert [(r.request_id, r.device_id, r.is_streaming, float(r.total_cost_usd)) for r in got] == [("q", "d", True, 0.5)]
    with pytest.raises(ValueError, match="version"):
        load(version=2)
    for bad in ({"inputTokens": -1}, {"model": " "}, {"createdAt": 0}, {"requestId": None}):
        with pytest.raises(ValueError, match="invalid"):
            X.import_usage(load(**bad), fact)


def test_report_and_chart(make_usage, spark):
    df = make_usage(
        [
            dict(model="a", output_tokens=10, total_cost_usd="1", provider_id="p1"),
            dict(model="b", output_tokens=5, total_cost_usd="3", provider_id="p2", created_at=T + 3 * 86400),
        ]
    )
    q = UsageQuery(T - 86400, T + 4 * 86400)
    out = usage_report(df, q)
    assert out["summary"].first().total_requests == 2
    assert [r.cumulative for r in out["chart"].collect()] == [0, 10, 10, 10, 15, 15]
    assert [r.kind for r in out["insights"].orderBy("ordinal").collect()] == ["top_model", "cache_watch", "top_provider", "trend"]
    picked = usage_report(df, UsageQuery(q.start, q.end, provider_name="p1"))
    assert {(r.dimension, r.name) for r in picked["options"].collect()} == {
        ("provider", "p1"), ("provider", "p2"), ("model", "a"),
    }
    assert picked["models"].first().model == "a" and picked["log"].count() == 1
    trends = A.usage_trends(df, q.start, q.start + 200 * 86400)
    assert trend_chart(trends, q.start, q.start + 200 * 86400).count() == 2  # too long to fill
    assert trend_delta(trends).first().trend_delta == 200.0
    none = df.filter("false")
    empty = insight_feed(A.usage_summary(none), A.usage_trends(none, 0, 1), A.provider_stats(none), A.model_stats(none))
    assert [r.kind for r in empty.collect()] == ["no_data"]


def land(df, path):
    df.coalesce(1).write.mode("append").parquet(path)


def test_stream_is_idempotent(make_usage, spark, tmp_path):
    src, chk = str(tmp_path / "in"), str(tmp_path / "chk")
    log = S.usage_log(spark, str(tmp_path / "fact"))
    first = make_usage([{"request_id": i, "output_tokens": 1} for i in "aab"])

    def run():
        stream = S.watch(spark, src, first.schema, files_per_batch=1)
        S.start(stream, S.ingest_batch(log), chk).awaitTermination()
        return {(r.request_id, r.output_tokens) for r in log.read().collect()}

    land(first, src)
    assert run() == {("a", 1), ("b", 1)}
    late = make_usage([{"request_id": i, "output_tokens": 2, "created_at": 5} for i in "abc"])
    land(late, src)
    assert run() == {("a", 1), ("b", 1), ("c", 2)}
    S.ingest_batch(log)(late, 1)  # the same batch again, as after a crash
    assert log.read().count() == 3
    assert "event_date" in log.read().columns


def test_settling_across_batches(spark, tmp_path):
    schema = "file_path string, line_no bigint, request_id string, created_at bigint"
    nullable = spark.createDataFrame([], schema).schema
    out, pending = BatchLog(spark, str(tmp_path / "o"), nullable), VersionedTable(spark, str(tmp_path / "p"), nullable)
    now = [1000]
    each = S.settle_batch(out, pending, lambda: now[0])
    each(spark.createDataFrame([("f", 1, "a", 400), ("f", 2, "b", 500), ("f", 3, "c", 100), ("g", 1, "d", 10)], schema), 0)
    assert {r.request_id for r in out.read().collect()} == {"a", "d"}
    now[0] = 1100
    each(spark.createDataFrame([("f", 4, "e", 1000)], schema), 1)
    assert {r.request_id for r in out.read().collect()} == {"a", "d", "b", "c"}
    assert [r.request_id for r in pending.latest().collect()] == ["e"]


def test_live_suppression_equals_the_batch_rule(make_usage, spark, tmp_path):
    rows = []
    for i in range(60):
        at = T + i * 100
        rows.append(dict(request_id=f"s{i}", data_source="codex_session", app_type="codex", input_tokens=i % 5, created_at=at))
        if i % 3 == 0:
            rows.append(dict(request_id=f"p{i}", data_source="proxy", app_type="codex", input_tokens=i % 5,
                             created_at=at + (i * 37) % 1300 - 650, cache_creation_tokens=i % 2, model=("unknown", "z")[i % 2]))
    rows.append(dict(request_id="end-s", data_source="codex_session", created_at=T + 10**6, input_tokens=99))
    rows.append(dict(request_id="end-p", data_source="proxy", created_at=T + 10**6, input_tokens=98))
    df = make_usage(rows)
    src = str(tmp_path / "in")
    land(df, src)
    stream = lambda: S.watch(spark, src, df.schema)
    live = S.suppress_live(stream().filter("data_source <> 'proxy'"), stream().filter("data_source = 'proxy'"))
    sink = str(tmp_path / "out")
    live.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(sink).awaitTermination()
    got = {r.request_id for r in spark.read.schema(df.schema).parquet(sink).collect()}
    want = {r.request_id for r in effective_usage(df).filter("data_source <> 'proxy'").collect()} - {"end-s"}
    assert got == want and 0 < len(want) < 60


def test_live_dedup(make_usage, spark, tmp_path):
    df = make_usage([{"request_id": i} for i in "aabbc"])
    src, sink = str(tmp_path / "in"), str(tmp_path / "out")
    land(df, src)
    live = S.dedup_live(S.watch(spark, src, df.schema))
    live.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(sink).awaitTermination()
    assert spark.read.parquet(sink).count() == 3


def test_counter_state_takes_each_line_once(spark, tmp_path):
    schema = "thread_id string, line_no bigint, input bigint, cached bigint, output bigint"
    out = BatchLog(spark, str(tmp_path / "o"), S.DELTA_ROWS)
    state = VersionedTable(spark, str(tmp_path / "s"), S.COUNTER_STATE)
    each = S.counter_batch(out, state, chunk_rows=2)
    first = [("t", 1, 10, 4, 1), ("t", 2, 10, 4, 1), ("t", 3, 15, 20, 1), ("u", 9, 1, 0, 0)]
    each(spark.createDataFrame(first, schema), 0)
    each(spark.createDataFrame([*first, ("t", 4, 12, 21, 3)], schema), 1)
    got = {(r.thread_id, r.line_no, r.event_index, r.input_tokens, r.cache_read_tokens, r.output_tokens) for r in out.read().collect()}
    assert got == {("t", 1, 1, 10, 4, 1), ("t", 3, 2, 5, 5, 0), ("u", 9, 1, 1, 0, 0), ("t", 4, 3, 0, 0, 2)}
    assert {(r.thread_id, r.line_no, r.events) for r in state.latest().collect()} == {("t", 4, 3), ("u", 9, 1)}
