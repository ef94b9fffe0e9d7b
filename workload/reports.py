"""Report queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokentide.operators import analytics as A, insights as I
from tokentide.operators.dedup import effective_usage
from tokentide.operators.filters import UsageQuery
from tokentide.plans.report import filter_options, usage_report
from tokentide.functions.tokens import fresh_input, real_total

from .views import ALL_END, ALL_START, T0, WITH_EFFECTIVE, WITH_USAGE, big, money, usage

DAY = 86400
HOURS = (T0 + 10 * DAY, T0 + 12 * DAY)
DAYS = (T0 - 6 * DAY, T0 + 35 * DAY)
WHOLE = UsageQuery(ALL_START, ALL_END)
SOME = UsageQuery(T0 + 3 * DAY, T0 + 24 * DAY, app_type="claude", model="gpt-5.4", device_id="dev-1")
PICKED = UsageQuery(T0, T0 + 30 * DAY, provider_name="vendor", model="GLM-5.2")


def view(spark, sf, q=WHOLE):
    return effective_usage(usage(spark, sf), q)


def summary(spark, sf):
    return A.usage_summary(view(spark, sf))


def trends(spark, sf, span):
    return A.usage_trends(view(spark, sf, UsageQuery(*span)), *span)


def usage_report_bundle(spark, sf):
    """The overview's summary and choices, folded from one staged cube."""
    report = usage_report(usage(spark, sf), WHOLE)
    return report["summary"].select("total_requests", "total_cost", "real_total_tokens")


def usage_report_sections(spark, sf):
    """Every section of the overview as (section, key, value)."""
    report = usage_report(usage(spark, sf), WHOLE)
    kinds = {
        "trends": ("date", "total_tokens"),
        "providers": ("provider_id", "request_count"),
        "models": ("model", "total_cost"),
        "composition": ("part", "tokens"),
        "log": ("request_id", "created_at"),
        "log_total": (None, "total"),
        "options": ("name", None),
    }
    out = None
    for section, (key, value) in kinds.items():
        part = report[section].select(
            F.lit(section).alias("section"),
            (F.col(key) if key else F.lit(None)).cast("string").alias("key"),
            (F.col(value) if value else F.lit(None)).cast("double").alias("value"),
        )
        out = part if out is None else out.unionByName(part)
    return out


QUERIES = {
    "usage_report_sections": usage_report_sections,
    "usage_summary": summary,
    "usage_summary_filtered": lambda s, d: A.usage_summary(view(s, d, SOME)),
    "usage_trends_day": lambda s, d: trends(s, d, DAYS),
    "usage_trends_hour": lambda s, d: trends(s, d, HOURS),
    "provider_stats": lambda s, d: A.provider_stats(view(s, d)),
    "model_stats": lambda s, d: A.model_stats(view(s, d)),
    "device_stats": lambda s, d: A.device_stats(usage(s, d), "dev-home", "Home"),
    "request_log_page": lambda s, d: _money_columns(A.request_log_page(view(s, d), 3, 25)),
    "request_log_after": lambda s, d: _money_columns(
        A.request_log_after(view(s, d), T0 + 20 * DAY, "ev:0", 50)
    ),
    "request_log_total": lambda s, d: A.log_total(view(s, d, UsageQuery(status_code=500))),
    "request_detail": lambda s, d: _money_columns(A.request_detail(usage(s, d), "ev:5")),
    "filter_options": lambda s, d: filter_options(usage(s, d), PICKED),
    "usage_report": usage_report_bundle,
    "effective_usage": lambda s, d: view(s, d).select(
        "request_id", "app_type", "model", "created_at", fresh_input().alias("fresh"), real_total().alias("total")
    ),
    "daily_rollup": lambda s, d: A.daily_rollup(usage(s, d)),
    "profile_usage": lambda s, d: A.profile_usage(usage(s, d)),
    "trend_gap_filled": lambda s, d: I.trend_chart(trends(s, d, DAYS), *DAYS),
    "trend_gap_filled_hour": lambda s, d: I.trend_chart(trends(s, d, HOURS), *HOURS),
    "trend_delta": lambda s, d: I.trend_delta(trends(s, d, DAYS)),
    "activity_rhythm": lambda s, d: I.activity_rhythm(trends(s, d, DAYS)),
    "trend_strip": lambda s, d: I.trend_strip(I.trend_chart(trends(s, d, DAYS), *DAYS)),
    "token_composition": lambda s, d: I.token_composition(summary(s, d)),
    "cost_share_top3": lambda s, d: I.top_models(A.cost_shares(A.cube(view(s, d), hourly=False))),
    "top_providers": lambda s, d: I.top_providers(A.provider_stats(view(s, d))),
    "provider_health": lambda s, d: A.provider_stats(view(s, d)).select(
        "provider_id", "success_rate", I.health(F.col("success_rate")).alias("health")
    ),
    "insight_cards": lambda s, d: I.insight_cards(summary(s, d), trends(s, d, DAYS)),
    "insight_feed": lambda s, d: usage_report(usage(s, d), WHOLE)["insights"],
}


def _money_columns(df):
    costs = [c for c in df.columns if c.endswith("_usd")]
    return df.withColumns(
        {
            **{c: F.round(c, 6).cast("double") for c in costs},
            "cost_multiplier": F.col("cost_multiplier").cast("double"),
        }
    )


def _summary_sql(source: str) -> str:
    return f"""SELECT COUNT(*) AS total_requests, {money('COALESCE(SUM(total_cost_usd), 0)')} AS total_cost,
  {big('COALESCE(SUM(fresh), 0)')} AS input_tokens, {big('COALESCE(SUM(output_tokens), 0)')} AS output_tokens,
  {big('COALESCE(SUM(cache_read_tokens), 0)')} AS cache_read_tokens,
  {big('COALESCE(SUM(cache_creation_tokens), 0)')} AS cache_creation_tokens,
  {big('COALESCE(SUM(total), 0)')} AS real_total_tokens,
  ROUND(COALESCE(SUM(CASE WHEN status_code BETWEEN 200 AND 299 THEN 1 ELSE 0 END) * 100.0::DOUBLE
        / NULLIF(COUNT(*), 0), 0), 6) AS success_rate,
  ROUND(COALESCE(SUM(cache_read_tokens) * 100.0::DOUBLE
        / NULLIF(SUM(fresh + cache_creation_tokens + cache_read_tokens), 0), 0), 6) AS cache_hit_rate
FROM {source}"""


def _trend_sql(span, fmt) -> str:
    return f"""SELECT strftime(make_timestamp(created_at * 1000000), '{fmt}') AS date, COUNT(*) AS request_count,
  {money('SUM(total_cost_usd)')} AS total_cost, {big('SUM(total)')} AS total_tokens,
  {big('SUM(fresh)')} AS input_tokens, {big('SUM(output_tokens)')} AS output_tokens,
  {big('SUM(cache_read_tokens)')} AS cache_read_tokens,
  {big('SUM(cache_creation_tokens)')} AS cache_creation_tokens
FROM eff WHERE created_at BETWEEN {span[0]} AND {span[1]} GROUP BY 1"""


_TREND = f"{WITH_EFFECTIVE}, tr AS ({_trend_sql(DAYS, '%Y-%m-%d')})"

_LOG = """SELECT request_id, provider_id, provider_name, app_type, model, request_model, pricing_model,
  input_tokens, fresh AS fresh_input_tokens, output_tokens, cache_read_tokens, cache_creation_tokens,
  {0} AS total_cost_usd, {1} AS input_cost_usd, {2} AS output_cost_usd, {3} AS cache_read_cost_usd,
  {4} AS cache_creation_cost_usd, latency_ms, status_code, CAST(NULL AS VARCHAR) AS error_message, session_id,
  true AS is_streaming, 1.0::DOUBLE AS cost_multiplier, created_at, data_source""".format(
    *[
        money(c)
        for c in (
            "total_cost_usd",
            "input_cost_usd",
            "output_cost_usd",
            "cache_read_cost_usd",
            "cache_creation_cost_usd",
        )
    ]
)

_PROVIDERS = f"""SELECT provider_id, MAX(provider_name) AS provider_name, COUNT(*) AS request_count,
  {big('SUM(total)')} AS total_tokens, {money('SUM(total_cost_usd)')} AS total_cost,
  ROUND(SUM(CASE WHEN status_code BETWEEN 200 AND 299 THEN 1 ELSE 0 END) * 100.0::DOUBLE / COUNT(*), 6)
    AS success_rate,
  ROUND(SUM(latency_ms)::DOUBLE / COUNT(*), 6) AS avg_latency_ms
FROM eff GROUP BY provider_id"""

_MODELS = f"""SELECT effective_model AS model, COUNT(*) AS request_count, {big('SUM(total)')} AS total_tokens,
  {money('SUM(total_cost_usd)')} AS total_cost,
  ROUND(SUM(total_cost_usd)::DOUBLE / COUNT(*), 6) AS avg_cost_per_request
FROM eff GROUP BY 1"""


def _chart_sql(trend: str, span, unit: str, fmt: str, length: int) -> str:
    return f"""{WITH_EFFECTIVE}, tr AS ({trend}),
spine AS (SELECT strftime(x, '{fmt}') AS bucket
          FROM generate_series(date_trunc('{unit}', make_timestamp({span[0]}::BIGINT * 1000000)),
                               make_timestamp({span[1]}::BIGINT * 1000000), INTERVAL 1 {unit}) AS g(x)),
chart AS (
SELECT bucket, COALESCE(total_cost, 0) AS cost, COALESCE(request_count, 0) AS requests,
  COALESCE(total_tokens, 0) AS total, COALESCE(input_tokens, 0) AS input, COALESCE(output_tokens, 0) AS output,
  COALESCE(cache_creation_tokens, 0) AS cache_creation, COALESCE(cache_read_tokens, 0) AS cache_read,
  {big('SUM(COALESCE(total_tokens, 0)) OVER (ORDER BY bucket)')} AS cumulative
FROM spine LEFT JOIN tr ON substr(tr.date, 1, {length}) = bucket)"""


_DAY_CHART = _chart_sql(_trend_sql(DAYS, "%Y-%m-%d"), DAYS, "day", "%Y-%m-%d", 10)
_HOUR_CHART = _chart_sql(_trend_sql(HOURS, "%Y-%m-%d %H:00:00"), HOURS, "hour", "%Y-%m-%d %H", 13)

_DELTA = """latest AS (SELECT *, row_number() OVER (ORDER BY date DESC) AS rn FROM tr
            WHERE request_count > 0 OR total_cost > 0),
delta AS (SELECT MAX(CASE WHEN rn = 2 THEN total_cost END) AS previous_cost,
                 MAX(CASE WHEN rn = 1 THEN total_cost END) AS latest_cost FROM latest),
d AS (SELECT previous_cost, latest_cost,
        CASE WHEN previous_cost > 0 THEN ROUND((latest_cost - previous_cost) / previous_cost * 100, 6) END
          AS trend_delta FROM delta)"""

def daily_sql(source: str) -> str:
    return f"""SELECT strftime(make_timestamp(created_at * 1000000), '%Y-%m-%d') AS date, app_type, provider_id, model,
  COALESCE(request_model, '') AS request_model, COALESCE(pricing_model, '') AS pricing_model,
  COUNT(*) AS request_count, {big('SUM(CASE WHEN status_code BETWEEN 200 AND 299 THEN 1 ELSE 0 END)')}
    AS success_count,
  {big('SUM(input_tokens)')} AS input_tokens, {big('SUM(output_tokens)')} AS output_tokens,
  {big('SUM(cache_read_tokens)')} AS cache_read_tokens,
  {big('SUM(cache_creation_tokens)')} AS cache_creation_tokens,
  {money('SUM(total_cost_usd)')} AS total_cost_usd, {big('ROUND(AVG(latency_ms))')} AS avg_latency_ms
FROM {source} GROUP BY 1, 2, 3, 4, 5, 6"""


ORACLES = {
    "usage_report_sections": f"""{WITH_EFFECTIVE}, s AS ({_summary_sql('eff')})
SELECT 'trends' AS section, strftime(make_timestamp(created_at * 1000000), '%Y-%m-%d') AS key, SUM(total)::DOUBLE AS value FROM eff GROUP BY 2
UNION ALL SELECT 'providers', provider_id, COUNT(*) FROM eff GROUP BY 2
UNION ALL SELECT 'models', effective_model, {money('SUM(total_cost_usd)')} FROM eff GROUP BY 2
UNION ALL SELECT 'composition', 'input', input_tokens FROM s UNION ALL SELECT 'composition', 'output', output_tokens FROM s
UNION ALL SELECT 'composition', 'cache_read', cache_read_tokens FROM s UNION ALL SELECT 'composition', 'cache_write', cache_creation_tokens FROM s
UNION ALL (SELECT 'log', request_id, created_at FROM eff ORDER BY created_at DESC, request_id LIMIT 10)
UNION ALL SELECT 'log_total', NULL, COUNT(*) FROM eff
UNION ALL (SELECT 'options', provider_name, NULL FROM eff GROUP BY 2)
UNION ALL (SELECT 'options', effective_model, NULL FROM eff GROUP BY 2)""",
    "usage_summary": f"{WITH_EFFECTIVE} {_summary_sql('eff')}",
    "usage_summary_filtered": f"""{WITH_EFFECTIVE} {_summary_sql('eff')}
WHERE created_at BETWEEN {SOME.start} AND {SOME.end} AND app_type IN ('claude', 'claude-desktop')
  AND effective_model = 'gpt-5.4' AND device_id = 'dev-1'""",
    "usage_trends_day": f"{WITH_EFFECTIVE} {_trend_sql(DAYS, '%Y-%m-%d')}",
    "usage_trends_hour": f"{WITH_EFFECTIVE} {_trend_sql(HOURS, '%Y-%m-%d %H:00:00')}",
    "provider_stats": f"{WITH_EFFECTIVE} {_PROVIDERS}",
    "model_stats": f"{WITH_EFFECTIVE} {_MODELS}",
    "device_stats": f"""{WITH_USAGE}
SELECT device_id, COALESCE(NULLIF(MAX(device_name), ''), device_id) AS device_name, false AS is_local,
  COUNT(*) AS request_count, MAX(created_at) AS last_seen FROM u GROUP BY device_id
UNION ALL SELECT 'dev-home', 'Home', true, 0, NULL""",
    "request_log_page": f"{WITH_EFFECTIVE} {_LOG} FROM eff ORDER BY created_at DESC, request_id LIMIT 25 OFFSET 50",
    "request_log_after": f"""{WITH_EFFECTIVE} {_LOG} FROM eff
WHERE created_at < {T0 + 20 * DAY} OR (created_at = {T0 + 20 * DAY} AND request_id > 'ev:0')
ORDER BY created_at DESC, request_id LIMIT 50""",
    "request_log_total": f"{WITH_EFFECTIVE} SELECT COUNT(*) AS total FROM eff WHERE status_code = 500",
    "request_detail": f"{WITH_USAGE} {_LOG} FROM u WHERE request_id = 'ev:5'",
    "filter_options": f"""{WITH_EFFECTIVE}, r AS (SELECT * FROM eff WHERE created_at BETWEEN {PICKED.start} AND {PICKED.end})
SELECT 'provider' AS dimension, provider_name AS name FROM r UNION SELECT 'provider', 'vendor'
UNION SELECT 'model', effective_model FROM r WHERE provider_name = 'vendor' UNION SELECT 'model', 'GLM-5.2'""",
    "usage_report": f"""{WITH_EFFECTIVE}, s AS ({_summary_sql('eff')})
SELECT total_requests, total_cost, real_total_tokens FROM s""",
    "effective_usage": f"{WITH_EFFECTIVE} SELECT request_id, app_type, model, created_at, fresh, total FROM eff",
    "daily_rollup": f"{WITH_USAGE} {daily_sql('u')}",
    "profile_usage": f"""{WITH_USAGE}
SELECT 'rows' AS section, CAST(NULL AS VARCHAR) AS key, COUNT(*)::DOUBLE AS value FROM u
UNION ALL SELECT 'first_created_at', NULL, MIN(created_at) FROM u
UNION ALL SELECT 'last_created_at', NULL, MAX(created_at) FROM u
UNION ALL SELECT 'zero_cost_rows', NULL, COUNT(*) FROM u WHERE total_cost_usd = 0
UNION ALL SELECT 'rows_by_source', data_source, COUNT(*) FROM u GROUP BY data_source
UNION ALL SELECT 'zero_cost_by_model', model, COUNT(*) FROM u WHERE total_cost_usd = 0 GROUP BY model
UNION ALL (SELECT 'top_models_by_cost', model, {money('SUM(total_cost_usd)')} FROM u GROUP BY model
           ORDER BY 3 DESC, model LIMIT 10)""",
    "trend_gap_filled": f"{_DAY_CHART} SELECT * FROM chart",
    "trend_gap_filled_hour": f"{_HOUR_CHART} SELECT * FROM chart",
    "trend_delta": f"{_TREND}, {_DELTA} SELECT * FROM d",
    "activity_rhythm": f"""{_TREND}, r AS (SELECT * FROM tr WHERE request_count > 0 OR total_cost > 0
                                          ORDER BY date DESC LIMIT 12)
SELECT date, request_count,
  ROUND(GREATEST(8.0, request_count * 100.0::DOUBLE / GREATEST((SELECT MAX(request_count) FROM r), 1)), 6) AS height,
  date = (SELECT date FROM r ORDER BY request_count DESC, date LIMIT 1) AS is_peak FROM r""",
    "trend_strip": f"""{_DAY_CHART} SELECT {big('SUM(total)')} AS total_tokens,
  COUNT(*) FILTER (WHERE requests > 0 OR total > 0 OR cost > 0) AS active_buckets,
  {big('SUM(requests)')} AS total_requests,
  (SELECT bucket FROM chart ORDER BY total DESC, bucket LIMIT 1) AS peak_bucket,
  {big('MAX(total)')} AS peak_tokens FROM chart""",
    "token_composition": f"""{WITH_EFFECTIVE}, s AS ({_summary_sql('eff')}),
p AS (SELECT 0 AS ordinal, 'input' AS part, input_tokens AS tokens FROM s
      UNION ALL SELECT 1, 'output', output_tokens FROM s
      UNION ALL SELECT 2, 'cache_read', cache_read_tokens FROM s
      UNION ALL SELECT 3, 'cache_write', cache_creation_tokens FROM s)
SELECT ordinal, part, tokens, ROUND(tokens * 100.0::DOUBLE / (SELECT SUM(tokens) FROM p), 6) AS share FROM p""",
    "cost_share_top3": f"""{WITH_EFFECTIVE}, m AS ({_MODELS})
SELECT model, request_count, total_cost,
  ROUND(total_cost / (SELECT {money('SUM(total_cost_usd)')} FROM eff) * 100, 6) AS share,
  ROUND(total_cost / GREATEST((SELECT MAX(total_cost) FROM m), 1.0) * 100, 6) AS bar
FROM m ORDER BY total_cost DESC, model LIMIT 3""",
    "top_providers": f"{WITH_EFFECTIVE}, p AS ({_PROVIDERS}) SELECT * FROM p ORDER BY request_count DESC, provider_id LIMIT 3",
    "provider_health": f"""{WITH_EFFECTIVE}, p AS ({_PROVIDERS})
SELECT provider_id, success_rate, CASE WHEN success_rate >= 99 THEN 'good' WHEN success_rate >= 95 THEN 'stable'
  ELSE 'watch' END AS health FROM p""",
    "insight_cards": f"""{_TREND}, {_DELTA}, s AS ({_summary_sql('eff')})
SELECT ROUND(total_cost / total_requests, 6) AS average_cost, cache_hit_rate, cache_read_tokens, success_rate,
  trend_delta FROM s, d""",
    "insight_feed": f"""{_TREND}, {_DELTA}, s AS ({_summary_sql('eff')}), p AS ({_PROVIDERS}), m AS ({_MODELS})
SELECT 0 AS ordinal, 'top_model' AS kind, 'violet' AS tone, model AS subject,
  ROUND(m.total_cost * 100.0::DOUBLE / s.total_cost, 6) AS value
  FROM s, (SELECT * FROM m ORDER BY total_cost DESC, model LIMIT 1) m
UNION ALL SELECT 1, CASE WHEN cache_hit_rate >= 20 THEN 'cache_good' ELSE 'cache_watch' END,
  CASE WHEN cache_hit_rate >= 20 THEN 'emerald' ELSE 'amber' END, NULL, cache_hit_rate FROM s
UNION ALL SELECT 2, 'top_provider', CASE WHEN s.success_rate >= 95 THEN 'cyan' ELSE 'amber' END, provider_name,
  p.success_rate FROM s, (SELECT * FROM p ORDER BY request_count DESC, provider_id LIMIT 1) p
UNION ALL SELECT 3, 'trend', CASE WHEN trend_delta > 0 THEN 'amber' ELSE 'cyan' END,
  CASE WHEN trend_delta > 0 THEN 'up' ELSE 'down' END, ROUND(ABS(trend_delta), 6) FROM d""",
}
