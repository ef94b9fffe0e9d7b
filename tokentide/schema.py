"""Table layouts and the constants that fix the meaning of a usage record."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

# --- fixed values: meaning of input_tokens in a record -----------------------
SEMANTICS_LEGACY = 0  # unmarked rows
SEMANTICS_TOTAL = 1  # input_tokens includes the cache tokens
SEMANTICS_FRESH = 2  # input_tokens excludes the cache tokens

# --- fixed values: source names, app names, provider placeholders ------------
SOURCE_PROXY = "proxy"
SOURCE_CLAUDE = "session_log"
SOURCE_CODEX = "codex_session"
SOURCE_GEMINI = "gemini_session"
SOURCE_OPENCODE = "opencode_session"
SOURCE_ZCODE = "zcode_session"
SOURCE_GROK = "grok_session"

# Apps that count cache tokens inside input_tokens.
CACHE_INCLUSIVE_APPS = ("codex", "gemini", "grokbuild", "zcode")
# Sources hidden at read time when the proxy saw the same request (not grok).
READ_DEDUP_SOURCES = (SOURCE_CLAUDE, SOURCE_CODEX, SOURCE_GEMINI, SOURCE_OPENCODE, SOURCE_ZCODE)
# Sources, and their apps, that may leave cache_creation_tokens unreported (0).
OPEN_CACHE_SOURCES = (SOURCE_CODEX, SOURCE_GEMINI, SOURCE_OPENCODE, SOURCE_ZCODE)
OPEN_CACHE_APPS = ("codex", "gemini", "opencode", "zcode")
# Sources touched by re-pricing (grok included).
SESSION_SOURCES = READ_DEDUP_SOURCES + (SOURCE_GROK,)

PROVIDER_NAMES = {
    "_session": "Claude (Session)",
    "_codex_session": "Codex (Session)",
    "_gemini_session": "Gemini (Session)",
    "_opencode_session": "OpenCode (Session)",
    "_zcode_session": "ZCode (Session)",
    "_grok_session": "Grok Build (Session)",
}

DEDUP_WINDOW_SECONDS = 600
SETTLE_WINDOW_SECONDS = 600
HOURLY_RANGE_SECONDS = 2 * 24 * 3600
GAP_FILL_RANGE_SECONDS = 90 * 24 * 3600
MAX_TOKEN_COUNT = 4294967295
PRICE_SOURCE_BUILTIN = "Built-in fallback"
PRICE_SOURCE_LIVE = "OpenRouter live"
TRANSFER_VERSION = 1
# -----------------------------------------------------------------------------

MONEY = T.DecimalType(28, 18)
PRICE = T.DecimalType(18, 12)

TOKEN_COLUMNS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")
COST_COLUMNS = (
    "input_cost_usd",
    "output_cost_usd",
    "cache_read_cost_usd",
    "cache_creation_cost_usd",
    "total_cost_usd",
)
PRICE_COLUMNS = (
    "input_cost_per_million",
    "output_cost_per_million",
    "cache_read_cost_per_million",
    "cache_creation_cost_per_million",
)

USAGE_SCHEMA = T.StructType(
    [
        T.StructField("request_id", T.StringType(), False),
        T.StructField("provider_id", T.StringType(), False),
        T.StructField("app_type", T.StringType(), False),
        T.StructField("model", T.StringType(), False),
        T.StructField("request_model", T.StringType()),
        T.StructField("pricing_model", T.StringType()),
        *[T.StructField(c, T.LongType()) for c in TOKEN_COLUMNS],
        T.StructField("input_token_semantics", T.IntegerType()),
        *[T.StructField(c, MONEY) for c in COST_COLUMNS],
        T.StructField("latency_ms", T.LongType()),
        T.StructField("first_token_ms", T.LongType()),
        T.StructField("duration_ms", T.LongType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("provider_type", T.StringType()),
        T.StructField("is_streaming", T.BooleanType()),
        T.StructField("cost_multiplier", T.DecimalType(10, 4)),
        T.StructField("created_at", T.LongType(), False),
        T.StructField("data_source", T.StringType()),
        T.StructField("device_id", T.StringType()),
        T.StructField("device_name", T.StringType()),
    ]
)

PRICING_SCHEMA = T.StructType(
    [
        T.StructField("model_id", T.StringType(), False),
        T.StructField("display_name", T.StringType()),
        *[T.StructField(c, PRICE) for c in PRICE_COLUMNS],
        T.StructField("price_source", T.StringType()),
        T.StructField("price_fetched_at", T.LongType()),
    ]
)

CURSOR_SCHEMA = T.StructType(
    [
        T.StructField("file_path", T.StringType(), False),
        T.StructField("last_modified", T.LongType()),
        T.StructField("last_line_offset", T.LongType()),
        T.StructField("last_synced_at", T.LongType()),
    ]
)

_DEFAULTS = {
    **{c: 0 for c in TOKEN_COLUMNS},
    **{c: 0 for c in COST_COLUMNS},
    "input_token_semantics": SEMANTICS_LEGACY,
    "latency_ms": 0,
    "status_code": 200,
    "is_streaming": True,
    "cost_multiplier": 1,
    "data_source": SOURCE_PROXY,
    "device_id": "",
    "device_name": "",
}


def conform(df: DataFrame) -> DataFrame:
    """Project any frame onto the usage layout; absent columns take their default."""
    columns = []
    for field in USAGE_SCHEMA:
        default = F.lit(_DEFAULTS.get(field.name)).cast(field.dataType)
        if field.name not in df.columns:
            columns.append(default.alias(field.name))
            continue
        value = F.col(field.name).cast(field.dataType)
        if field.name in _DEFAULTS:
            value = F.coalesce(value, default)
        columns.append(value.alias(field.name))
    return df.select(*columns)
