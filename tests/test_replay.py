"""Rollout logs: counters, classification and removal of replayed history."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tokentide.operators.replay import parent_timeline, replay_prefix, resolve_parents
from tokentide.plans.ingest import rollout_rows, rollout_tables
from tokentide.sources.rollouts import classify_threads, rollout_records, token_events

NOW = 1_800_000_000


def uid(n):
    return f"00000000-0000-4000-8000-{n:012d}"


def path(n, folder="sessions"):
    return f"/h/{folder}/rollout-x-{uid(n)}.jsonl"


def at(second):
    return f"2024-01-01T00:{second // 60:02d}:{second % 60:02d}Z"


def meta(n, second=0, **payload):
    return json.dumps({"type": "session_meta", "timestamp": at(second), "payload": {"id": uid(n), **payload}})


def token(total=None, last=None, second=0, model=None, **info):
    if total is not None:
        info["total_token_usage"] = dict(zip(("input_tokens", "cached_input_tokens", "output_tokens"), total))
    if last is not None:
        info["last_token_usage"] = dict(zip(("input_tokens", "cached_input_tokens", "output_tokens"), last))
    if model:
        info["model"] = model
    body = {"type": "event_msg", "payload": {"type": "token_count", "info": info}}
    if second is not None:
        body["timestamp"] = at(second)
    return json.dumps(body)


def lines_of(make_lines, logs):
    return make_lines(logs)


def deltas(make_lines, *texts):
    events = token_events(rollout_records(make_lines({path(1): texts})), chunk_rows=2)
    rows = events.orderBy("line_no").collect()
    return [(r.input_tokens, r.cache_read_tokens, r.output_tokens, r.event_index, r.position, r.model) for r in rows]


def test_deltas(make_lines):
    got = deltas(
        make_lines,
        meta(1),
        token((100, 80, 20)),
        json.dumps({"type": "turn_context", "payload": {"info": {"model": "OpenAI/GPT-5.6-SOL-20260305"}}}),
        token((90, 70, 25)),
        token((90, 70, 25)),
        token(last=(7, 9, 1), model="gpt-5"),
        token((100, 90, 30)),
    )
    assert got == [
        (100, 80, 20, 1, 1, "unknown"),
        (0, 0, 5, 2, 2, "gpt-5.6-sol"),
        (0, 0, 0, None, 3, "gpt-5.6-sol"),
        (7, 7, 1, 3, 4, "gpt-5"),
        (10, 10, 5, 4, 5, "gpt-5"),
    ]


def test_key_presence_decides(make_lines):
    def raw(info):
        return json.dumps({"type": "event_msg", "payload": {"type": "token_count", "info": info}})

    got = deltas(
        make_lines,
        # present but no number: the second name is not consulted
        raw({"total_token_usage": {"input_tokens": 50, "cached_input_tokens": "x", "cache_read_input_tokens": 9}}),
        # total present but null: dropped, yet it names the model
        raw({"total_token_usage": None, "last_token_usage": {"input_tokens": 5}, "model": "gpt-5.5"}),
        # neither counter is an object: dropped and names nothing
        raw({"total_token_usage": None, "model": "other"}),
        raw({"total_token_usage": {"input_tokens": 60, "cache_read_input_tokens": 4}}),
        raw({"total_token_usage": {"input_tokens": -5, "output_tokens": 2.5}}),
    )
    assert got == [
        (50, 0, 0, 1, 1, "unknown"),
        (10, 4, 0, 2, 2, "gpt-5.5"),
        (0, 0, 0, None, 3, "gpt-5.5"),
    ]


def statuses(make_lines, logs):
    records = rollout_records(lines_of(make_lines, logs))
    out = resolve_parents(classify_threads(records), records, chunk_rows=3).collect()
    return {r.file_path: (r.parent_status, r.pending, r.pending_reason) for r in out}


def test_classification(make_lines):
    spawned = {"source": {"subagent": {"thread_spawn": {"parent_thread_id": uid(1)}}}}
    got = statuses(
        make_lines,
        {
            path(1): [meta(1), token((1, 0, 0), second=5), token((2, 0, 0), second=50)],
            path(2): [meta(2, 9, forked_from_id=uid(1), **spawned)],
            path(3): [meta(3, 9, forked_from_id=uid(7), **spawned)],
            path(4): [meta(9, 9)],
            path(5): [meta(5, 9, forked_from_id="not-a-thread")],
            path(6): [meta(6, 9, forked_from_id=uid(6))],
            path(7): [token((1, 1, 1))],
            path(8): [meta(8, 9, forked_from_id=uid(99))],
            path(10): [meta(10, 55, forked_from_id=uid(1).upper())],
            "/h/sessions/rollout-x.jsonl": [meta(1)],
            path(11): [meta(11).replace(at(0), "soon").replace('"id"', '"forked_from_id": "%s", "id"' % uid(1))],
        },
    )
    assert got[path(1)][:2] == ("none", None)
    assert got[path(2)][:2] == ("parent", None)
    assert got[path(3)][:2] == ("deferred", "stable")
    assert got[path(4)][:2] == ("deferred", "stable")
    assert got[path(5)][:2] == ("deferred", "stable")
    assert got[path(6)][:2] == ("deferred", "stable")
    assert got[path(7)] == (None, "stable", "no meta record")
    assert got[path(8)][:2] == ("parent", "missing_parent")
    assert got[path(10)][:2] == ("parent", "retryable")
    assert got["/h/sessions/rollout-x.jsonl"][1:] == ("stable", "file name has no thread id")
    assert got[path(11)][1:] == ("stable", "meta record has no time")


def test_copies_must_agree_up_to_the_fork(make_lines):
    parent = [meta(1), token((1, 0, 0), second=5), token((2, 0, 0), second=50)]
    child = [meta(2, 20, forked_from_id=uid(1)), token((1, 0, 0), second=21)]
    later = parent[:2] + [token((9, 0, 0), second=50)]
    other = [meta(1), token((7, 0, 0), second=5), token((2, 0, 0), second=50)]
    short = parent + [token((3, 0, 0), second=6)]
    for second_copy, pending in ((parent, None), (later, None), (other, "retryable"), (short, "retryable")):
        got = statuses(
            make_lines, {path(1): parent, path(1, "archived_sessions"): second_copy, path(2): child}
        )
        assert got[path(2)][1] == pending


def test_parent_event_without_time(make_lines):
    got = statuses(
        make_lines,
        {
            path(1): [meta(1), token((1, 0, 0), second=None), token((2, 0, 0), second=50)],
            path(2): [meta(2, 20, forked_from_id=uid(1)), token((1, 0, 0))],
        },
    )
    assert got[path(2)][1:] == ("retryable", "parent event has no time")


def greedy(child, parent):
    offset = matched = 0
    for event in child:
        try:
            offset = parent.index(event, offset) + 1
        except ValueError:
            break
        matched += 1
    return matched


@pytest.mark.parametrize("seed", range(2))
def test_prefix_equals_greedy_matching(spark, make_lines, seed):
    """Few distinct signatures force repeats, skips and falls; some parents run backwards."""
    rnd = random.Random(seed)
    logs, expected = {}, {}
    fork = 60
    for k in range(12):
        n = k * 10
        times = [rnd.randrange(0, 120) for _ in range(rnd.randrange(5, 25))]
        if k % 2:
            times.sort()
        values = [rnd.randrange(1, 5) for _ in times]
        logs[path(n)] = [meta(n)] + [token((v, 0, 0), second=t) for v, t in zip(values, times)] + [
            json.dumps({"type": "other", "timestamp": at(500)})
        ]
        before = [v for v, t in zip(values, times) if t <= fork]
        for c in range(3):
            if c == 0:
                copy = before + [rnd.randrange(1, 7) for _ in range(4)]
            elif c == 1:
                copy = [v for v in before if rnd.random() < 0.6] + [rnd.randrange(1, 7) for _ in range(4)]
            else:
                copy = [rnd.randrange(1, 5) for _ in range(15)]
            child = n + 1 + c
            logs[path(child)] = [meta(child, fork, forked_from_id=uid(n))] + [
                token((v, 0, 0), second=100) for v in copy
            ]
            expected[path(child)] = greedy(copy, before)
    records, threads, events = rollout_tables(lines_of(make_lines, logs), chunk_rows=4)
    rows = replay_prefix(threads, events, parent_timeline(records), chunk_rows=4).collect()
    result = {r.file_path: r.replay_prefix for r in rows}
    assert {p: result.get(p, 0) for p in expected} == expected
    assert len(result) == len(rows)


def test_replayed_events_are_dropped_but_numbered(make_lines):
    logs = {
        path(1): [meta(1), token((10, 0, 0), second=1), token((20, 0, 0), second=2), token((35, 0, 0), second=90)],
        path(2): [
            meta(2, 30, forked_from_id=uid(1)),
            token((10, 0, 0), second=31),
            token((20, 0, 0), second=31),
            token((50, 0, 0), second=40),
        ],
        path(3): [meta(3, 30, forked_from_id=uid(4)), token((1, 0, 0), second=31)],
    }
    rows, threads = rollout_rows(lines_of(make_lines, logs), NOW)
    got = {(r.request_id, r.input_tokens) for r in rows.collect()}
    prefix = "codex_session:thread-v1:"
    assert got == {
        (f"{prefix}{uid(1)}:1", 10),
        (f"{prefix}{uid(1)}:2", 10),
        (f"{prefix}{uid(1)}:3", 15),
        (f"{prefix}{uid(2)}:3", 30),
    }
    assert threads.filter("pending = 'missing_parent'").count() == 1
    assert threads.filter(F.col("pending").isNull()).count() == 2


def test_many_falls_take_few_rounds(spark, monkeypatch):
    """A child that leaves out two in five of its parent's events, of five signatures: falls by the hundred."""
    from tokentide.operators import replay

    rounds, real = [], replay._raised
    monkeypatch.setattr(replay, "_raised", lambda *args: rounds.append(1) or real(*args))
    rnd = random.Random(11)
    parent = [rnd.randrange(5) for _ in range(600)]
    copies = {f"c{k}": [v for v in parent if rnd.random() < 0.6] + [7, 1] for k in range(3)} | {"exact": parent[:400], "none": [9]}
    start = "timestamp'2024-01-01'"
    timeline = spark.createDataFrame([("p", i + 1, str(v)) for i, v in enumerate(parent)], "file_path string, line_no bigint, signature string")
    timeline = timeline.withColumn("ts", F.expr(f"{start} + make_dt_interval(0, 0, 0, line_no)"))
    threads = spark.createDataFrame([(c,) for c in copies], "file_path string").withColumns(
        {"parent_path": F.lit("p"), "parent_status": F.lit("parent"), "pending": F.lit(None).cast("string"), "fork_ts": F.expr(f"{start} + interval 500 seconds")}
    )
    events = spark.createDataFrame([(c, n + 1, str(v)) for c, some in copies.items() for n, v in enumerate(some)], "file_path string, position bigint, signature string")
    got = {r.file_path: r.replay_prefix for r in replay_prefix(threads, events, timeline, chunk_rows=100).collect()}
    assert got == {c: greedy(some, parent[:500]) for c, some in copies.items()}
    assert 1 < len(rounds) < 16
