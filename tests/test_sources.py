"""Golden records per source, and line numbering of real files."""

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tokentide.operators.cursors import message_watermarks, usage_watermarks
from tokentide.operators.pricing import price_usage, seed_prices
from tokentide.plans.ingest import finish, finish_grok, ingest_all
from tokentide.schema import USAGE_SCHEMA
from tokentide.sources import landed as L
from tokentide.sources.claude import claude_usage
from tokentide.sources.gemini import gemini_usage
from tokentide.sources.grok import deferred_files, grok_events, grok_usage, settled_events
from tokentide.sources.lines import CLAUDE_FILES, GEMINI_FILES, GROK_FILES, ROLLOUT_FILES, only_files, read_documents, read_lines
from tokentide.sources.opencode import opencode_incomplete, opencode_usage
from tokentide.sources.zcode import zcode_incomplete, zcode_usage

NOW = 1_800_000_000


def turn(mid="m1", output=50, stop=None, session="s", **usage):
    usage = {"input_tokens": 3, "output_tokens": output, "cache_read_input_tokens": 5000, **usage}
    record = {
        "type": "assistant",
        "timestamp": "2023-11-14T22:13:20Z",
        "message": {"id": mid, "model": "claude-x", "usage": usage},
    }
    if session:
        record["sessionId"] = session
    if stop:
        record["message"]["stop_reason"] = stop
    return json.dumps(record)


def by_id(df):
    return {r.request_id: r for r in df.collect()}


def test_claude_final_version_wins(make_lines):
    lines = make_lines(
        {
            "/projects/p/a.jsonl": [
                turn("m0", session=None),
                "not json",
                "  ",
                turn(output=50, session="first"),
                turn(output=200, stop="end_turn", session="second"),
                turn(output=900),
                turn("m2", output=7),
                turn("m2", output=9),
                turn("m2", output=9, cache_creation_input_tokens=77),
                json.dumps({"type": "user", "message": {"id": "u", "usage": {"input_tokens": 1}}}),
                json.dumps({"type": "assistant", "message": {"id": 5, "usage": {"input_tokens": 1}}}),
                json.dumps({"type": "assistant", "message": {"id": "zero", "usage": {"input_tokens": "12", "output_tokens": -4}}}),
                json.dumps({"type": "assistant", "timestamp": "late", "message": {"id": "m3", "model": 4, "usage": {"output_tokens": 1}}}),
            ]
        }
    )
    rows = by_id(claude_usage(lines, NOW))
    assert set(rows) == {"session:m0", "session:m1", "session:m2", "session:m3"}
    assert (rows["session:m1"].output_tokens, rows["session:m1"].session_id) == (200, "first")
    assert rows["session:m1"].created_at == 1_700_000_000
    assert (rows["session:m2"].output_tokens, rows["session:m2"].cache_creation_tokens) == (9, 0)
    assert rows["session:m0"].session_id is None
    assert (rows["session:m3"].model, rows["session:m3"].created_at) == ("unknown", NOW)


def test_gemini(spark):
    chat = {
        "sessionId": "c",
        "messages": [
            {"id": "a", "type": "gemini", "model": "g", "timestamp": "2023-11-14T22:13:20Z",
             "tokens": {"input": 100, "output": 20, "cached": 30, "thoughts": 7}},
            {"id": "b", "type": "user", "tokens": {"input": 1}},
            {"id": "z", "type": "gemini", "tokens": {"input": 0}},
            {"type": "gemini", "tokens": {"output": 1}},
        ],
    }
    df = spark.createDataFrame([("f", json.dumps(chat)), ("g", "[]"), ("h", "{}")], "file_path string, value string")
    rows = by_id(gemini_usage(df, NOW))
    assert set(rows) == {"gemini_session:c:a", "gemini_session:c:unknown"}
    a = rows["gemini_session:c:a"]
    assert (a.input_tokens, a.output_tokens, a.cache_read_tokens, a.created_at) == (100, 27, 30, 1_700_000_000)
    assert rows["gemini_session:c:unknown"].model == "unknown"


def test_opencode(spark):
    def data(**more):
        return json.dumps(
            {
                "role": "assistant", "modelID": "gpt-5", "cost": 0.01,
                "tokens": {"input": 100, "output": 20, "reasoning": 5, "cache": {"read": 30, "write": 4}},
                "time": {"created": 1780000000123, "completed": 1}, **more,
            }
        )

    rows = [
        ("m1", data()), ("m2", data(time={"created": 5})), ("m3", data(role="user")),
        ("m4", data(cost=0)), ("m5", "oops"), ("m6", data(cost="1", time={"completed": None})),
    ]
    df = spark.createDataFrame([(i, "s", n, d) for n, (i, d) in enumerate(rows)],
                               "id string, session_id string, time_created bigint, data string")
    got = by_id(price_usage(opencode_usage(df, NOW), seed_prices(spark)))
    assert set(got) == {f"opencode_session:s:{m}" for m in ("m1", "m4", "m6")}
    one = got["opencode_session:s:m1"]
    assert (one.output_tokens, one.created_at, float(one.total_cost_usd)) == (25, 1780000000, 0.01)
    assert one.input_cost_usd == 0
    assert got["opencode_session:s:m4"].total_cost_usd == Decimal("0.00037875")
    assert got["opencode_session:s:m6"].created_at == NOW
    assert opencode_incomplete(df).first().incomplete == 1


def test_zcode(spark):
    schema = """id string, session_id string, model_id string, input_tokens bigint, output_tokens bigint,
    reasoning_tokens bigint, cache_creation_input_tokens bigint, cache_read_input_tokens bigint, started_at bigint,
    completed_at bigint, duration_ms bigint, time_to_first_token_ms bigint"""
    df = spark.createDataFrame(
        [
            ("a", "s", "glm-5", 100, 20, 5, 3, 30, 1780000000123, 1780000001000, 900, -4),
            ("b", "s", " ", 2**32, -1, None, 0, 0, None, 1780000001000, -2, None),
            ("c", "s", "x", 1, 1, 1, 1, 1, 1, None, 1, 1),
            ("d", "s", "x", 0, 0, 0, 0, 0, 1, 1, 1, 1),
        ],
        schema,
    )
    got = by_id(zcode_usage(df, NOW))
    assert set(got) == {"zcode_session:a", "zcode_session:b"}
    a, b = got["zcode_session:a"], got["zcode_session:b"]
    assert (a.output_tokens, a.created_at, a.latency_ms, a.first_token_ms) == (25, 1780000000, 900, 0)
    assert (b.model, b.input_tokens, b.output_tokens, b.created_at, b.latency_ms) == ("unknown", 4294967295, 0, 1780000001, 0)
    assert b.first_token_ms is None
    assert zcode_incomplete(df).first().incomplete == 1
    sessions = spark.createDataFrame([("s", 5, None), ("t", 7, None)], "id string, time_created bigint, time_updated bigint")
    assert {r.session_id: r.watermark for r in usage_watermarks(sessions, df).collect()} == {"s": 1780000001000, "t": 7}


def test_message_watermarks(spark):
    sessions = spark.createDataFrame([("s", 5), ("t", 7)], "id string, time_updated bigint")
    messages = spark.createDataFrame([("s", 9), ("s", 3)], "session_id string, time_updated bigint")
    assert {r.session_id: r.watermark for r in message_watermarks(sessions, messages).collect()} == {"s": 9, "t": 7}


def update(at, kind="turn_completed", prompt="p", **usage):
    body = {"usage": usage or {"inputTokens": 5}}
    if kind:
        body["sessionUpdate"] = kind
    if prompt:
        body["prompt_id"] = prompt
    return json.dumps({"timestamp": at, "method": "_x.ai/session/update", "params": {"update": body}})


def test_grok(make_lines, make_usage, spark):
    counters = {"inputTokens": 100, "outputTokens": 10, "cachedReadTokens": 20, "costUsdTicks": 5_000_000_000}
    lines = make_lines(
        {
            "/h/sessions/dir1/updates.jsonl": [
                update(1_700_000_000_000, modelUsage={"grok-4.5-build": counters, "b": {"inputTokens": 0}}),
                update(1_700_000_100, kind="usage_snapshot"),
                update("2023-11-14T22:15:00Z", prompt=None, kind=None, **counters),
                update(True),
                update(1_700_000_400, prompt="q", costIsPartial=True, modelUsage={"grok-4": counters, "house": counters}),
                update(1_700_001_000, prompt="young"),
                update(1_600_000_000, prompt="behind"),
            ]
        }
    )
    events = grok_events(lines, chunk_rows=2)
    as_of = 1_700_001_599
    rows = by_id(grok_usage(settled_events(events, as_of)))
    prefix = "grok_session:dir1:"
    assert set(rows) == {f"{prefix}p:grok-4.5-build", f"{prefix}idx1:unknown", f"{prefix}q:grok-4", f"{prefix}q:house"}
    first = rows[f"{prefix}p:grok-4.5-build"]
    assert (first.input_tokens, first.cache_read_tokens, first.created_at) == (100, 20, 1_700_000_000)
    assert rows[f"{prefix}idx1:unknown"].created_at == 1_700_000_100
    assert deferred_files(events, as_of).count() == 1
    assert settled_events(events, as_of + 1).count() == 5

    fact = make_usage([dict(data_source="proxy", app_type="grokbuild", created_at=1_700_000_000 + 1000, status_code=500)])
    kept = by_id(finish_grok(grok_usage(settled_events(events, as_of)), fact, seed_prices(spark), device_id="d", device_name="D"))
    assert set(kept) == {f"{prefix}p:grok-4.5-build", f"{prefix}idx1:unknown"}
    far = fact.withColumn("created_at", F.lit(5).cast("bigint"))
    priced = by_id(finish_grok(grok_usage(settled_events(events, as_of)), far, seed_prices(spark)))
    assert priced[f"{prefix}p:grok-4.5-build"].total_cost_usd == Decimal("0.5")  # reported
    assert priced[f"{prefix}p:grok-4.5-build"].input_cost_usd == Decimal("0.00016")
    assert priced[f"{prefix}q:grok-4"].total_cost_usd == Decimal("0.000405")  # partial: calculated
    assert priced[f"{prefix}q:house"].total_cost_usd == Decimal("0.5")  # unpriced: even partial
    assert kept[f"{prefix}idx1:unknown"].device_id == "d"
    assert [f.name for f in USAGE_SCHEMA] == finish(grok_usage(events), far, seed_prices(spark)).columns


def test_one_failing_source_does_not_stop_the_others(make_lines, make_usage, spark):
    def broken():
        raise OSError("gone")

    lines = make_lines({"/projects/p/a.jsonl": [turn("a"), turn("b")], "/projects/p/b.jsonl": [turn("b")]})
    rows, report = ingest_all(
        spark,
        {"session_log": lambda: claude_usage(lines, NOW), "zcode_session": broken},
        make_usage([{"request_id": "session:a"}]),
        seed_prices(spark),
    )
    got = {r.data_source: (r.imported, r.skipped, r.error is not None) for r in report.collect()}
    assert got == {"session_log": (1, 2, False), "zcode_session": (0, 0, True)}
    assert [r.request_id for r in rows.collect()] == ["session:b"]


def test_line_numbers_over_many_splits(spark, tmp_path):
    texts = {"a.jsonl": [f"a{i}" * (i % 7 + 1) for i in range(1, 3000)], "b.jsonl": ["x", "", "y"], "c.txt": ["no"]}
    for name, lines in texts.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = read_lines(spark, str(tmp_path), glob="*.jsonl")
        assert df.rdd.getNumPartitions() > 3
        got = {(r.file_name, r.line_no): r.value for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {(n, i): t for n in ("a.jsonl", "b.jsonl") for i, t in enumerate(texts[n], 1)}
    assert read_documents(spark, str(tmp_path), glob="c.txt").first().value == "no\n"


PATHS = [
    (CLAUDE_FILES, "/h/projects/p/s.jsonl", True),
    (CLAUDE_FILES, "/h/projects/p/s/subagents/t.jsonl", True),
    (CLAUDE_FILES, "/h/projects/p/s/subagents/workflows/wf_1/t.jsonl", True),
    (CLAUDE_FILES, "/h/projects/p/s/other/t.jsonl", False),
    (ROLLOUT_FILES, "/h/sessions/2024/01/02/r.jsonl", True),
    (ROLLOUT_FILES, "/h/sessions/2024/01/02/x/r.jsonl", False),
    (ROLLOUT_FILES, "/h/archived_sessions/r.jsonl", True),
    (GEMINI_FILES, "/h/tmp/p/chats/session-1.json", True),
    (GEMINI_FILES, "/h/tmp/p/chats/other.json", False),
    (GROK_FILES, "/h/sessions/a/b/updates.jsonl", True),
    (GROK_FILES, "/h/sessions/a/b/notes.jsonl", False),
]


@pytest.mark.parametrize("pattern,path,wanted", PATHS)
def test_paths(spark, pattern, path, wanted):
    df = spark.createDataFrame([(path,)], "file_path string")
    assert only_files(df, pattern).count() == int(wanted)


def test_benchmark_points(spark):
    doc = {
        "points": [
            {"model": "harbor-2", "effort": "high", "iq": 88.5, "total": 41, "average_price_usd": -0.5, "average_minutes": 3},
            {"model": "harbor-2", "effort": "low", "total": 41},
            {"model": "harbor-3", "effort": "low", "iq": 70, "total": 0},
            {"model": "", "effort": "low", "iq": 61, "total": 9},
            {"model": "harbor-4", "effort": "", "iq": 61, "total": 9},
            {"model": "harbor-5", "effort": "low", "iq": 150.5, "total": 9},
        ]
    }
    df = spark.createDataFrame([(json.dumps(doc),)], "value string")
    rows = L.valid_points(L.benchmark_points(df)).collect()
    assert [(r.model, r.point_no, r.average_price_usd) for r in rows] == [("harbor-2", 0, None)]
    empty = spark.createDataFrame([('{"points":[]}',)], "value string")
    with pytest.raises(ValueError):
        L.require_rows(L.valid_points(L.benchmark_points(empty)), "no samples")


def test_quota_section(spark):
    html = """<strong>before</strong><span>$7</span><em>outside</em><section data-k="1" class="wide quota-radar">
    <h2>额度雷达 <span> as of noon </span></h2>
    <strong>Team&nbsp;A</strong> <span>$2,310.40</span><em>counted &amp; checked</em>
    <strong>Team B</strong><span>$55</span> <em>half of a week</em>
    <title>week 31 20x Pro 7d $900.10</title><title>week 32 20x Pro 7d $2,310.40</title></section>
    <section class="quota-radar"><strong>late</strong><span>$3</span><em>no</em></section>"""
    df = spark.createDataFrame([(1, html), (2, "<section class='x'></section>")], "page_id int, html string")
    sections = L.quota_sections(df, "page_id")
    assert sections.first().source_updated_at == "as of noon"
    tiers = L.quota_tiers(sections, "page_id").collect()
    assert [(r.plan, r.weekly_usd, r.source) for r in tiers] == [("Team A", 2310.4, "counted & checked"), ("Team B", 55.0, "half of a week")]
    assert [r.label for r in L.quota_history(sections, "page_id").collect()] == ["week 31", "week 32"]
