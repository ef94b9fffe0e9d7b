from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tokentide.functions import money, names, times, tokens
from tokentide.operators import analytics as A
from tokentide.operators.filters import UsageQuery
from tokentide.operators.dedup import effective_usage
from tokentide.schema import PRICE_COLUMNS


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def cost(make_usage, app, multiplier=None, **counts):
    df = make_usage([{"app_type": app, **counts}])
    priced = df.withColumns({c: F.lit(p) for c, p in zip(PRICE_COLUMNS, ("3.0", "15.0", "0.3", "3.75"))})
    return priced.select(*[c.alias(n) for n, c in money.cost_columns(multiplier).items()]).first()


COUNTS = dict(input_tokens=1000, output_tokens=500, cache_read_tokens=200, cache_creation_tokens=100)


def test_cost_of_fresh_input(make_usage):
    row = cost(make_usage, "claude", **COUNTS)
    assert (row.input_cost_usd, row.total_cost_usd) == (Decimal("0.003"), Decimal("0.010935"))


def test_cost_of_cache_inclusive_input(make_usage):
    row = cost(make_usage, "codex", **COUNTS)
    assert (row.input_cost_usd, row.total_cost_usd) == (Decimal("0.0021"), Decimal("0.010035"))


def test_multiplier_applies_to_the_total_only(make_usage):
    row = cost(make_usage, "claude", F.lit("1.5"), input_tokens=1000)
    assert (row.input_cost_usd, row.total_cost_usd) == (Decimal("0.003"), Decimal("0.0045"))


def test_billable_input_never_negative(make_usage):
    row = cost(make_usage, "codex", input_tokens=10, cache_read_tokens=50)
    assert row.input_cost_usd == 0


def test_largest_counts_stay_exact(make_usage):
    row = cost(make_usage, "claude", input_tokens=4294967295, output_tokens=1)
    assert row.total_cost_usd == Decimal("12884.901900000000000000")


FRESH = [
    ("codex", 1000, 600, 100, 1, 300),
    ("codex", 1000, 600, 100, 0, 400),
    ("claude", 200, 5000, 0, 0, 200),
    ("codex", 100, 600, 100, 1, 100),  # smaller than the cache: kept
    ("codex", 650, 600, 100, 1, 650),
    ("zcode", 500, 600, 0, 0, 500),
    ("gemini", 1000, 600, 100, 2, 1000),
    ("opencode", 1000, 600, 100, 1, 1000),
]


@pytest.mark.parametrize("app,given,read,written,kind,fresh", FRESH)
def test_fresh_input(make_usage, app, given, read, written, kind, fresh):
    df = make_usage(
        [
            {
                "app_type": app,
                "input_tokens": given,
                "cache_read_tokens": read,
                "cache_creation_tokens": written,
                "input_token_semantics": kind,
            }
        ]
    )
    assert df.select(tokens.fresh_input()).first()[0] == fresh


def test_summary_figures(make_usage):
    df = make_usage(
        [
            dict(app_type="codex", input_tokens=1000, output_tokens=0, cache_read_tokens=900, input_token_semantics=1),
            dict(app_type="claude", input_tokens=100, status_code=500),
        ]
    )
    row = A.usage_summary(df).first()
    assert row.cache_hit_rate == pytest.approx(900 / 1100 * 100, abs=1e-6)
    assert (row.total_requests, row.input_tokens, row.success_rate) == (2, 200, 50.0)


def test_all_reports_agree_on_one_row(make_usage):
    df = make_usage(
        [
            dict(
                provider_id="_codex_session",
                app_type="codex",
                data_source="codex_session",
                input_tokens=1000,
                output_tokens=50,
                cache_read_tokens=600,
                cache_creation_tokens=100,
                input_token_semantics=1,
            )
        ]
    )
    q = UsageQuery(1_699_999_999, 1_700_000_001)
    view = effective_usage(df, q)
    s = A.usage_summary(view).first()
    assert (s.input_tokens, s.output_tokens, s.real_total_tokens, s.cache_hit_rate) == (300, 50, 1050, 60.0)
    assert A.provider_stats(view).first().provider_name == "Codex (Session)"
    assert A.provider_stats(view).first().total_tokens == 1050
    assert A.model_stats(view).first().total_tokens == 1050
    assert A.request_log_page(view, 0, 0).first().fresh_input_tokens == 300
    assert A.page_bounds(0, 0) == (0, 10)
    assert A.page_bounds(3, 500, max_size=500) == (1000, 500)
    hour = A.usage_trends(view, q.start, q.end).first()
    assert len(hour.date) == 19 and hour.date.endswith(":00:00") and hour.total_tokens == 1050
    day = A.usage_trends(view, q.start - 20 * 86400, q.end).first()
    assert len(day.date) == 10


def test_empty_input_gives_a_row_of_zeros(make_usage):
    row = A.usage_summary(make_usage([{}]).filter("false")).first()
    assert set(row.asDict().values()) == {0}


def test_bucket_follows_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Shanghai")
    try:
        assert one(spark, x=times.bucket_label(F.lit(1704060000), False)).x == "2024-01-01"
        assert str(one(spark, x=times.event_date(F.lit(1704060000))).x) == "2023-12-31"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


NAMES = [
    (names.strip_day, "claude-opus-4-20250514", "claude-opus-4"),
    (names.strip_day, "gpt-5", "gpt-5"),
    (names.strip_day, "x-2025051", "x-2025051"),
    (names.thread_model, "OpenAI/GPT-5.6-SOL-20260305", "gpt-5.6-sol"),
    (names.thread_model, "gpt-5-2025-08-07", "gpt-5"),
    (names.thread_model, "-20250807", "-20250807"),
    (names.thread_model, "a/b/GPT-5-20250101-2025-08-07", "gpt-5"),
    (names.catalog_key, "openai/gpt-5.4", "gpt-5-4"),
    (names.catalog_key, "gpt_5.4:batch", "gpt-5-4"),
    (names.catalog_key, "a/b/ X_y ", "x-y"),
    (names.provider_name, "_grok_session", "Grok Build (Session)"),
    (names.provider_name, "vendor", "vendor"),
    (names.base_name, "C:\\logs\\a.jsonl", "a.jsonl"),
]


@pytest.mark.parametrize("fn,given,expected", NAMES)
def test_names(spark, fn, given, expected):
    assert one(spark, x=fn(F.lit(given))).x == expected


TIMES = [
    ("2024-01-01T00:00:00Z", 1704067200),
    ("2024-01-01T08:00:00.123+08:00", 1704067200),
    ("2024-01-01 00:00:00z", 1704067200),
    ("2024-01-01T00:00:00", None),
    ("2024-13-01T00:00:00Z", None),
    ("soon", None),
]


@pytest.mark.parametrize("given,expected", TIMES)
def test_rfc3339(spark, given, expected):
    assert one(spark, x=times.rfc3339_seconds(F.lit(given))).x == expected


def test_epochs(spark):
    none = F.lit(None).cast("string")
    assert one(spark, x=times.mixed_epoch(F.lit(1700000000000), none)).x == 1700000000
    assert one(spark, x=times.mixed_epoch(F.lit(1700000000), none)).x == 1700000000
    assert one(spark, x=times.millis_to_seconds(F.lit(1780000000123), 7)).x == 1780000000
    assert one(spark, x=times.millis_to_seconds(F.lit(-1), 7)).x == 7


def test_clamp(spark):
    assert one(spark, x=tokens.clamp(F.lit(-1))).x == 0
    assert one(spark, x=tokens.clamp(F.lit(2**32))).x == 4294967295


MONEY = [("0.0000025", 2.5), ("0.000015", 15), ("0", 0), (" 0.000001 ", 1), ("-1", None), ("1e-6", None), ("x", None)]


@pytest.mark.parametrize("given,expected", MONEY)
def test_per_million(spark, given, expected):
    got = one(spark, x=money.per_million(F.lit(given))).x
    assert got is None if expected is None else float(got) == expected


def test_usd_and_entities(spark):
    assert one(spark, x=money.parse_usd(F.lit("1,649.72"))).x == 1649.72
    assert one(spark, x=money.parse_usd(F.lit("x"))).x is None
    assert one(spark, x=money.decode_text(F.lit(" a&nbsp;&amp;&#39;b "))).x == "a &'b"
    assert one(spark, x=money.ticks(F.lit(123))).x == Decimal("1.23E-8")
    assert one(spark, x=money.ticks(F.lit(0))).x is None


def test_ranges():
    now = 1704110400  # 2024-01-01 12:00 UTC
    midnight = 1704067200
    assert times.make_range("today", now) == (midnight, now)
    assert times.make_range("1d", now) == (now - 86400, now)
    assert times.make_range("7d", now) == (midnight - 6 * 86400, now)
    assert times.make_range("90d", now) == (midnight - 89 * 86400, now)
    assert times.make_range("all", now) == (946684800, now)
    assert times.make_range("custom", now, start=5) == (5, now)
    assert times.make_range("today", now, "Asia/Shanghai") == (midnight - 8 * 3600, now)
    with pytest.raises(ValueError):
        times.make_range("2d", now)
