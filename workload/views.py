"""Usage records derived from the events table, in Spark and as SQL.

Every event is one request; each fifth event was also recorded by the proxy,
some seconds later. The SQL text states the same rows for the check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tokentide.session import new_path

APPS = ("claude", "codex", "gemini", "opencode", "zcode", "grokbuild", "claude-desktop")
SOURCES = (
    "session_log",
    "codex_session",
    "gemini_session",
    "opencode_session",
    "zcode_session",
    "grok_session",
    "proxy",
)
PROVIDERS = (
    "_session",
    "_codex_session",
    "_gemini_session",
    "_opencode_session",
    "_zcode_session",
    "_grok_session",
    "vendor",
)
MODELS = ("claude-sonnet-4-6", "gpt-5.2-20250929", "GLM-5.2", "openai/gpt-5.4", "unknown", "house-model")
STORED_PRICES = {"input": "3", "output": "15", "cache_read": "0.3", "cache_creation": "3.75"}

T0 = 1704067200  # 2024-01-01
ALL_START, ALL_END = 946684800, T0 + 60 * 86400


def prepare(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession, sf_dir: str, name: str, key: str) -> str:
    """A folder with the table in files for all cores, for queries that make much of a row or read it often.

    A table in one file of one row group is read by one task, and what it makes of the rows as well.
    """
    folder = new_path(spark, "tables")
    table(spark, sf_dir, name).repartition(key).write.parquet(f"{folder}/{name}.parquet")
    return folder


def pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"),
    )


def _pick(values: tuple[str, ...], index: str) -> str:
    return "element_at(array({}), cast({} as int) + 1)".format(", ".join(f"'{v}'" for v in values), index)


def _cost(kind: str) -> str:
    amount = f"cast({kind}_tokens as decimal(12,0)) * cast({STORED_PRICES[kind]} as decimal(18,12)) * 0.000001BD"
    return f"cast(if(user_id % 6 < 4, {amount}, 0) as decimal(28,18)) AS {kind}_cost_usd"


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One SELECT per step; every column of the usage layout is produced here."""
    twins = events(spark, sf_dir).selectExpr(
        "*",
        "explode(if(event_id % 5 = 0, array(false, true), array(false))) AS twin",
        f"{_pick(APPS, 'event_id % 7')} AS app",
        f"{_pick(MODELS, 'user_id % 6')} AS request_model",
        "cast(floor(value * 100) as bigint) AS input_tokens",
        "k * 11 AS output_tokens",
        "k * 50 AS cache_read_tokens",
        "if(event_id % 3 = 0, 0, k) AS cache_creation_tokens",
    )
    costed = twins.selectExpr("*", *[_cost(kind) for kind in STORED_PRICES])
    source = f"if(twin, 'proxy', {_pick(SOURCES, 'event_id % 7')})"
    return costed.selectExpr(
        "concat(if(twin, 'px:', 'ev:'), event_id) AS request_id",
        f"if(twin, 'vendor', {_pick(PROVIDERS, 'event_id % 7')}) AS provider_id",
        "if(twin and app = 'claude' and event_id % 2 = 0, 'claude-desktop', app) AS app_type",
        "if(twin and k % 4 = 0, 'unknown', request_model) AS model",
        "request_model",
        "if(event_id % 11 = 0, 'gpt-5.4', null) AS pricing_model",
        "input_tokens",
        "output_tokens",
        "cache_read_tokens",
        "cache_creation_tokens",
        "cast(event_id % 3 as int) AS input_token_semantics",
        *[f"{kind}_cost_usd" for kind in STORED_PRICES],
        "cast({} as decimal(28,18)) AS total_cost_usd".format(" + ".join(f"{k}_cost_usd" for k in STORED_PRICES)),
        "k * 7 AS latency_ms",
        "cast(null as bigint) AS first_token_ms",
        "cast(null as bigint) AS duration_ms",
        "if(event_type = 'error', 500, 200) AS status_code",
        "cast(null as string) AS error_message",
        "concat('s-', user_id) AS session_id",
        f"{source} AS provider_type",
        "true AS is_streaming",
        "cast(1 as decimal(10,4)) AS cost_multiplier",
        "if(twin, t + k * 12, t) AS created_at",
        f"{source} AS data_source",
        "concat('dev-', user_id % 4) AS device_id",
        "if(user_id % 4 = 3, '', concat('Device ', user_id % 4)) AS device_name",
    )


# --- the same as SQL ----------------------------------------------------------

EVENTS_SQL = """
e AS (
  SELECT event_id, user_id, event_type, value,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
         CAST(epoch_us(ts) // 1000000 AS BIGINT) AS t
  FROM events
)"""


def sql_case(expression: str, values: tuple[str, ...]) -> str:
    return f"CASE {expression} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def sql_cost(tokens: str, price: str) -> str:
    return f"(CAST({tokens} AS DECIMAL(12,0)) * CAST({price} AS DECIMAL(10,6)) * CAST(0.000001 AS DECIMAL(7,6)))"


USAGE_SQL = f"""
raw AS (
  SELECT e.*, twin, {sql_case('event_id % 7', APPS)} AS app, {sql_case('user_id % 6', MODELS)} AS own_model,
         CAST(floor(value * 100) AS BIGINT) AS input_tokens, k * 11 AS output_tokens, k * 50 AS cache_read_tokens,
         CASE WHEN event_id % 3 = 0 THEN 0 ELSE k END AS cache_creation_tokens
  FROM e, (VALUES (false), (true)) AS v(twin)
  WHERE NOT twin OR event_id % 5 = 0
),
usage AS (
  SELECT CASE WHEN twin THEN 'px:' ELSE 'ev:' END || event_id AS request_id,
         CASE WHEN twin THEN 'vendor' ELSE {sql_case('event_id % 7', PROVIDERS)} END AS provider_id,
         CASE WHEN twin AND app = 'claude' AND event_id % 2 = 0 THEN 'claude-desktop' ELSE app END AS app_type,
         CASE WHEN twin AND k % 4 = 0 THEN 'unknown' ELSE own_model END AS model,
         own_model AS request_model,
         CASE WHEN event_id % 11 = 0 THEN 'gpt-5.4' END AS pricing_model,
         input_tokens, output_tokens, cache_read_tokens, cache_creation_tokens,
         event_id % 3 AS semantics,
         CASE WHEN user_id % 6 < 4 THEN {sql_cost('input_tokens', '3')} ELSE 0 END AS input_cost_usd,
         CASE WHEN user_id % 6 < 4 THEN {sql_cost('output_tokens', '15')} ELSE 0 END AS output_cost_usd,
         CASE WHEN user_id % 6 < 4 THEN {sql_cost('cache_read_tokens', '0.3')} ELSE 0 END AS cache_read_cost_usd,
         CASE WHEN user_id % 6 < 4 THEN {sql_cost('cache_creation_tokens', '3.75')} ELSE 0 END
           AS cache_creation_cost_usd,
         k * 7 AS latency_ms,
         CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code,
         's-' || user_id AS session_id,
         CASE WHEN twin THEN t + k * 12 ELSE t END AS created_at,
         CASE WHEN twin THEN 'proxy' ELSE {sql_case('event_id % 7', SOURCES)} END AS data_source,
         'dev-' || (user_id % 4) AS device_id,
         CASE WHEN user_id % 4 = 3 THEN '' ELSE 'Device ' || (user_id % 4) END AS device_name,
         event_type
  FROM raw
),
u AS (
  SELECT *, input_cost_usd + output_cost_usd + cache_read_cost_usd + cache_creation_cost_usd AS total_cost_usd,
         COALESCE(NULLIF(pricing_model, ''), model) AS effective_model,
         CASE provider_id WHEN '_session' THEN 'Claude (Session)' WHEN '_codex_session' THEN 'Codex (Session)'
              WHEN '_gemini_session' THEN 'Gemini (Session)' WHEN '_opencode_session' THEN 'OpenCode (Session)'
              WHEN '_zcode_session' THEN 'ZCode (Session)' WHEN '_grok_session' THEN 'Grok Build (Session)'
              ELSE provider_id END AS provider_name,
         CASE WHEN semantics = 2 THEN input_tokens
              WHEN app_type IN ('codex', 'gemini', 'grokbuild', 'zcode') AND semantics = 1
                   AND input_tokens >= cache_read_tokens + cache_creation_tokens
                THEN input_tokens - cache_read_tokens - cache_creation_tokens
              WHEN app_type IN ('codex', 'gemini', 'grokbuild', 'zcode') AND semantics = 0
                   AND input_tokens >= cache_read_tokens
                THEN input_tokens - cache_read_tokens
              ELSE input_tokens END AS fresh
  FROM usage
)"""

_MATCH = """l.input_tokens = p.input_tokens AND l.output_tokens = p.output_tokens
   AND l.cache_read_tokens = p.cache_read_tokens
   AND p.data_source = 'proxy' AND p.status_code >= 200 AND p.status_code < 300
   AND (p.app_type = l.app_type OR (l.app_type = 'claude' AND p.app_type = 'claude-desktop'))
   AND (p.cache_creation_tokens = l.cache_creation_tokens OR (l.cache_creation_tokens = 0 AND {open}))
   AND p.created_at BETWEEN l.created_at - 600 AND l.created_at + 600
   AND (lower(p.model) = lower(l.model) OR lower(p.model) = 'unknown' OR lower(l.model) = 'unknown')"""

MATCH_BY_SOURCE = _MATCH.format(
    open="l.data_source IN ('codex_session', 'gemini_session', 'opencode_session', 'zcode_session')"
)
MATCH_BY_APP = _MATCH.format(open="l.app_type IN ('codex', 'gemini', 'opencode', 'zcode')")

EFFECTIVE_SQL = f"""
hidden AS (
  SELECT DISTINCT l.request_id FROM u l JOIN u p ON {MATCH_BY_SOURCE}
  WHERE l.data_source IN ('session_log', 'codex_session', 'gemini_session', 'opencode_session', 'zcode_session')
),
eff AS (SELECT *, fresh + output_tokens + cache_read_tokens + cache_creation_tokens AS total
        FROM u WHERE request_id NOT IN (SELECT request_id FROM hidden))"""

WITH_USAGE = f"WITH {EVENTS_SQL},{USAGE_SQL}"
WITH_EFFECTIVE = f"{WITH_USAGE},{EFFECTIVE_SQL}"


def money(expression: str) -> str:
    return f"CAST(ROUND({expression}, 6) AS DOUBLE)"


def big(expression: str) -> str:
    return f"CAST({expression} AS BIGINT)"
