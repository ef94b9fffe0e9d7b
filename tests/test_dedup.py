"""Duplicate hiding against a brute-force reading of the rule."""

import itertools
import random

import pytest

from tokentide.operators.dedup import drop_near_activity, effective_usage, ingest_dedup
from tokentide.operators.filters import UsageQuery

T = 1_700_000_000
OPEN_SOURCES = {"codex_session", "gemini_session", "opencode_session", "zcode_session"}
OPEN_APPS = {"codex", "gemini", "opencode", "zcode"}
READ = OPEN_SOURCES | {"session_log"}


def matches(s, p, open_cache):
    apps = {s["app_type"], "claude-desktop" if s["app_type"] == "claude" else s["app_type"]}
    models = {s["model"].lower(), p["model"].lower()}
    return (
        p["data_source"] == "proxy"
        and 200 <= p["status_code"] < 300
        and p["app_type"] in apps
        and all(s[c] == p[c] for c in ("input_tokens", "output_tokens", "cache_read_tokens"))
        and (
            s["cache_creation_tokens"] == p["cache_creation_tokens"]
            or (open_cache and s["cache_creation_tokens"] == 0)
        )
        and abs(s["created_at"] - p["created_at"]) <= 600
        and (len(models) == 1 or "unknown" in models)
    )


def kept_by_source(rows):
    return {
        s["request_id"]
        for s in rows
        if not (
            s["data_source"] in READ and any(matches(s, p, s["data_source"] in OPEN_SOURCES) for p in rows)
        )
    }


def row(i, source, app, model, at, cache=5, status=200, tokens=(1, 2, 3)):
    return {
        "request_id": f"{source}-{i}",
        "data_source": source,
        "app_type": app,
        "model": model,
        "created_at": at,
        "cache_creation_tokens": cache,
        "status_code": status,
        **dict(zip(("input_tokens", "output_tokens", "cache_read_tokens"), tokens)),
    }


def ids(df):
    return {r.request_id for r in df.select("request_id").collect()}


def test_edges_one_at_a_time(make_usage):
    """Each pair has its own tokens, so pairs do not mix."""
    cases, expected = [], set()
    deltas = (0, 599, -599, 600, -600, 601, -601)
    models = (("A", "A"), ("A", "a"), ("A", "unknown"), ("UNKNOWN", "b"), ("a", "b"))
    caches = ((5, 5), (0, 5), (5, 0), (4, 5))
    apps = (("claude", "claude-desktop"), ("claude-desktop", "claude"), ("codex", "codex"), ("codex", "gemini"))
    sources = ("session_log", "codex_session", "zcode_session", "grok_session", "proxy")
    n = 0
    for delta, (ms, mp), (cs, cp), (as_, ap), source in itertools.product(deltas, models, caches, apps, sources):
        n += 1
        s = row(n, source, as_, ms, T + n % 1200, cs, tokens=(n, 0, 0))
        p = row(f"p{n}", "proxy", ap, mp, T + n % 1200 + delta, cp, tokens=(n, 0, 0))
        cases += [s, p]
        if not (source in READ and matches(s, p, source in OPEN_SOURCES)):
            expected.add(s["request_id"])
        expected.add(p["request_id"])
    assert ids(effective_usage(make_usage(cases))) == expected


@pytest.mark.parametrize("status,hidden", [(199, False), (200, True), (299, True), (300, False)])
def test_only_successful_proxies_hide(make_usage, status, hidden):
    rows = [row(1, "session_log", "claude", "a", T), row("p", "proxy", "claude", "a", T, status=status)]
    assert ("session_log-1" not in ids(effective_usage(make_usage(rows)))) == hidden


@pytest.mark.parametrize("seed", range(4))
def test_hot_tuple_against_brute_force(make_usage, seed):
    """Most rows share one token tuple, as a skewed key would."""
    rnd = random.Random(seed)
    rows = []
    for i in range(400):
        source = rnd.choice(["proxy", "proxy", "session_log", "codex_session", "zcode_session", "grok_session"])
        rows.append(
            row(
                i,
                source,
                rnd.choice(["claude", "claude-desktop", "codex"]),
                rnd.choice(["a", "A", "b", "c", "unknown"]),
                rnd.randrange(-3000, 9000),
                rnd.choice([0, 5]),
                rnd.choice([200, 200, 500]),
                rnd.choice([(1, 1, 1), (1, 1, 1), (2, 1, 1)]),
            )
        )
    df = make_usage(rows)
    assert ids(effective_usage(df)) == kept_by_source(rows)

    sessions = [r for r in rows if r["data_source"] != "proxy"]
    facts = [r for r in rows if r["data_source"] == "proxy"] + sessions[:20]
    known = {r["request_id"] for r in facts}
    expected = {
        s["request_id"]
        for s in sessions
        if s["request_id"] not in known and not any(matches(s, p, s["app_type"] in OPEN_APPS) for p in facts)
    }
    assert ids(ingest_dedup(make_usage(sessions), make_usage(facts))) == expected


def test_filter_does_not_limit_the_proxies(make_usage):
    rows = [
        row(1, "session_log", "claude", "a", T),
        row("p", "proxy", "claude-desktop", "a", T - 600),
    ]
    df = make_usage(rows)
    assert ids(effective_usage(df, UsageQuery(T, T + 5))) == set()
    assert ids(effective_usage(df, UsageQuery(T, T + 5, model="a", app_type="claude"))) == set()


def test_devices_can_be_kept_apart(make_usage):
    a = {**row(1, "session_log", "claude", "a", T), "device_id": "x"}
    b = {**row("p", "proxy", "claude", "a", T), "device_id": "y"}
    df = make_usage([a, b])
    assert len(ids(effective_usage(df))) == 1
    assert len(ids(effective_usage(df, by_device=True))) == 2


@pytest.mark.parametrize("seed", range(2))
def test_nearby_activity(make_usage, seed):
    rnd = random.Random(seed)
    turns = [row(i, "grok_session", "grokbuild", "a", rnd.randrange(0, 90000)) for i in range(150)]
    proxies = [
        row(f"p{i}", "proxy", rnd.choice(["grokbuild", "grokbuild", "codex"]), "z", rnd.randrange(0, 90000), status=500)
        for i in range(25)
    ] + [row("e", "proxy", "grokbuild", "z", turns[0]["created_at"] + 600)]
    expected = {
        t["request_id"]
        for t in turns
        if not any(p["app_type"] == "grokbuild" and abs(p["created_at"] - t["created_at"]) <= 600 for p in proxies)
    }
    assert ids(drop_near_activity(make_usage(turns), make_usage(proxies))) == expected


def test_partition_pruning_reaches_the_scan(make_usage, spark, tmp_path):
    from tokentide.operators.merge import write_usage

    path = str(tmp_path / "fact")
    write_usage(make_usage([row(i, "session_log", "claude", "a", T + i * 86400) for i in range(5)]), path)
    view = effective_usage(spark.read.parquet(path), UsageQuery(T + 86400, T + 2 * 86400))
    plan = view._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    assert view.count() == 2
