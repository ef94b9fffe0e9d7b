"""Incremental passes: nothing twice, nothing lost, deferred work retried."""

import json

from pyspark.sql import functions as F

from tokentide.operators import merge as M, pricing as P
from tokentide.plans import sync as Y
from tokentide.plans.ingest import ingest_all
from tokentide.schema import CURSOR_SCHEMA
from tokentide.session import staged

from .test_replay import meta, path, token, uid
from .test_sources import turn, update

NOW = 1_800_000_000


def with_times(lines, times):
    mapping = F.create_map(*[F.lit(x) for pair in times.items() for x in pair])
    return lines.withColumn("file_modified_ns", mapping[F.col("file_path")].cast("bigint"))


def ids(df):
    return sorted(r.request_id.split(":", 1)[1] for r in df.collect())


def store(cursors, changes):
    """The cursor table after a pass, written as a job would."""
    return staged(M.upsert(cursors, changes, ["file_path"]), "cursors")


def none(spark):
    return spark.createDataFrame([], CURSOR_SCHEMA)


def test_lines(make_lines, spark):
    a, b = "/projects/p/a.jsonl", "/projects/p/b.jsonl"
    lines = with_times(make_lines({a: [turn("1"), turn("2")], b: [turn("3")]}), {a: 5, b: 5})
    rows, changes = Y.sync_claude(lines, none(spark), NOW)
    assert ids(rows) == ["1", "2", "3"]
    cursors = store(none(spark), changes)
    grown = with_times(make_lines({a: [turn("1"), turn("2"), turn("4")], b: [turn("3"), turn("5")]}), {a: 9, b: 5})
    rows, changes = Y.sync_claude(grown, cursors, NOW)
    assert ids(rows) == ["4"]  # b has the same time, so it is not looked at
    assert [(r.file_path, r.last_modified, r.last_line_offset) for r in changes.collect()] == [(a, 9, 3)]


def test_documents(spark):
    doc = json.dumps({"sessionId": "c", "messages": [{"id": "a", "type": "gemini", "tokens": {"input": 1}}]})
    df = spark.createDataFrame([("f", 5, doc), ("g", 9, doc)], "file_path string, file_modified_ns bigint, value string")
    seen = spark.createDataFrame([("f", 5, 0, 1), ("g", 8, 0, 1)], CURSOR_SCHEMA)
    rows, changes = Y.sync_gemini(df, seen, NOW)
    assert ids(rows) == ["c:a"] and [r.file_path for r in changes.collect()] == ["g"]


def test_unsettled_file_keeps_its_cursor(make_lines, spark):
    a, b = "/h/sessions/a/updates.jsonl", "/h/sessions/b/updates.jsonl"
    lines = with_times(make_lines({a: [update(NOW - 700), update(NOW - 5, prompt="y")], b: [update(NOW - 900)]}), {a: 5, b: 5})
    rows, changes = Y.sync_grok(lines, none(spark), NOW)
    assert ids(rows) == ["a:p:unknown", "b:p:unknown"]
    assert [r.file_path for r in changes.collect()] == [b]


def test_rollouts(make_lines, spark):
    orphan, parent, child = path(2), path(1), path(3)
    first = {
        orphan: [meta(2, 30, forked_from_id=uid(1)), token((10, 0, 0), second=31), token((50, 0, 0), second=40)],
        child: [meta(3), token((1, 0, 0), second=1)],
    }
    rows, changes, threads = Y.sync_rollouts(with_times(make_lines(first), {orphan: 5, child: 5}), none(spark), NOW)
    assert ids(rows) == [f"thread-v1:{uid(3)}:1"]
    assert [r.file_path for r in changes.collect()] == [child]
    assert [r.pending for r in threads.filter("pending is not null").collect()] == ["missing_parent"]
    cursors = store(none(spark), changes)

    # The parent turns up, and the plain thread grows while it moves to the archive.
    archived = path(3, "archived_sessions")
    second = {
        orphan: first[orphan],
        parent: [meta(1), token((10, 0, 0), second=1), token((20, 0, 0), second=90)],
        archived: first[child] + [token((6, 0, 0), second=2)],
    }
    lines = with_times(make_lines(second), {orphan: 5, parent: 6, archived: 8})
    rows, changes, threads = Y.sync_rollouts(lines, cursors, NOW)
    assert ids(rows) == sorted([f"thread-v1:{uid(1)}:1", f"thread-v1:{uid(1)}:2", f"thread-v1:{uid(2)}:2", f"thread-v1:{uid(3)}:2"])
    assert {r.file_path: r.last_line_offset for r in changes.collect()} == {orphan: 3, parent: 3, archived: 3}
    known = store(cursors, changes)
    again, changes, _ = Y.sync_rollouts(lines, known, NOW)
    assert again.count() == 0 and changes.count() == 0

    # Only the child changes: its unchanged parent is read, but not emitted.
    grown = {**second, orphan: first[orphan] + [token((51, 0, 0), second=41)]}
    lines = with_times(make_lines(grown), {orphan: 9, parent: 6, archived: 8})
    rows, _, _ = Y.sync_rollouts(lines, known, NOW)
    assert ids(rows) == [f"thread-v1:{uid(2)}:3"]


def test_sessions(spark):
    def data(done=True):
        return json.dumps({"role": "assistant", "tokens": {"input": 1}, "time": {"created": 5000, **({"completed": 1} if done else {})}})

    sessions = spark.createDataFrame([("s", 1), ("t", 1), ("old", 1)], "id string, time_updated bigint")
    messages = spark.createDataFrame(
        [("a", "s", 1, 9, data()), ("b", "t", 1, 9, data()), ("c", "t", 1, 9, data(False)), ("d", "old", 1, 1, data())],
        "id string, session_id string, time_created bigint, time_updated bigint, data string",
    )
    seen = spark.createDataFrame([("db:old", 1, 0, 1)], CURSOR_SCHEMA)
    rows, changes = Y.sync_opencode(sessions, messages, seen, "db", NOW)
    assert ids(rows) == ["s:a", "t:b"]
    assert [(r.file_path, r.last_modified) for r in changes.collect()] == [("db:s", 9)]


def test_metrics_count_files(make_lines, make_usage, spark):
    from tokentide.sources.claude import claude_usage

    lines = make_lines({"/projects/p/a.jsonl": [turn("a")]})
    scans = {"session_log": spark.createDataFrame([("x", False), ("y", True)], "file_path string, deferred boolean")}
    builders = {"session_log": lambda: claude_usage(lines, NOW)}
    row = ingest_all(spark, builders, make_usage([{}]), P.seed_prices(spark), scans=scans)[1].first()
    assert (row.imported, row.files_scanned, row.deferred_files, row.suspected_duplicates) == (1, 2, 1, 0)


def test_recost_rewrites_only_touched_days(make_usage, spark, tmp_path):
    from pathlib import Path

    fact = str(tmp_path / "fact")
    M.write_usage(
        make_usage([
            dict(model="gpt-5", input_tokens=1_000_000, created_at=86400 * 3),
            dict(model="none", created_at=86400 * 3 + 1, total_cost_usd="2"),
            dict(model="none", created_at=86400 * 9),
        ]),
        fact,
    )
    before = {p.name: p.stat().st_mtime_ns for p in Path(fact).glob("event_date=1970-01-10/*.parquet")}
    recosted = P.recost(spark.read.parquet(fact), P.seed_prices(spark))
    M.rewrite_days(recosted, F.col("recost_status") == "updated", fact)
    after = {p.name: p.stat().st_mtime_ns for p in Path(fact).glob("event_date=1970-01-10/*.parquet")}
    assert before == after and before
    got = {r.request_id: float(r.total_cost_usd) for r in spark.read.parquet(fact).collect()}
    assert got == {"r0": 1.25, "r1": 2.0, "r2": 0.0}
