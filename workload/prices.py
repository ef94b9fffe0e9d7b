"""Pricing, catalog, benchmark and quota queries with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tokentide.operators import benchmark as B, pricing as P
from tokentide.operators.analytics import price_ranges
from tokentide.plans.refresh import refresh_and_recost
from tokentide.schema import COST_COLUMNS, PRICE_COLUMNS, PRICING_SCHEMA
from tokentide.sources import landed as L

from .views import WITH_USAGE, money, pick, sql_case, sql_cost, table, usage

FETCHED_AT = 1767225600

# --- price lookup and re-pricing ----------------------------------------------


def _rounded(df, columns):
    return df.withColumns({c: F.round(c, 6).cast("double") for c in columns})


def price_lookup(spark, sf):
    priced = P.with_prices(usage(spark, sf), P.seed_prices(spark))
    found = priced.groupBy("model", "priced_as").agg(
        F.count("*").alias("request_count"), *[F.max(c).alias(c) for c in PRICE_COLUMNS]
    )
    return _rounded(found, PRICE_COLUMNS)


def price_lookup_normalized(spark, sf):
    priced = P.with_prices(usage(spark, sf), P.seed_prices(spark), normalized=True)
    return priced.groupBy("model", "priced_as").agg(F.count("*").alias("request_count"))


def cost_breakdown(spark, sf):
    priced = P.price_usage(usage(spark, sf).drop(*COST_COLUMNS), P.seed_prices(spark))
    return _rounded(priced.select("request_id", *COST_COLUMNS), COST_COLUMNS)


def recosted(spark, sf, **options):
    out = P.recost(usage(spark, sf), P.seed_prices(spark), **options)
    return _rounded(out.select("request_id", "recost_status", *COST_COLUMNS), COST_COLUMNS)


def recost_metrics(spark, sf):
    return P.recost_metrics(P.recost(usage(spark, sf), P.seed_prices(spark), only_zero=True))


# --- catalog: local prices and catalog pages derived from parts ----------------


def local_prices(spark, sf):
    p = table(spark, sf, "part")
    date = F.when(F.col("p_partkey") % 3 == 0, "-20250101").otherwise("")
    size = F.col("p_size")
    local = p.filter("p_type <> 'SMALL'").select(
        F.concat(F.lit("model-"), "p_partkey", date).alias("model_id"),
        F.concat(F.lit("Model "), "p_partkey").alias("display_name"),
        size.alias("i"),
        (size * 4).alias("o"),
        F.lit("0.1").alias("r"),
        F.lit("0.25").alias("w"),
    )
    return local.select(
        "model_id",
        "display_name",
        *[F.col(x).cast("decimal(18,12)").alias(c) for x, c in zip("iorw", PRICE_COLUMNS)],
        F.lit("Built-in fallback").alias("price_source"),
        F.lit(None).cast("bigint").alias("price_fetched_at"),
    ).select(*PRICING_SCHEMA.names)


def per_token(hundredths: Column) -> Column:
    """Text of a per-token price worth so many hundredths of a dollar per million."""
    return F.concat(F.lit("0."), F.lpad(hundredths.cast("string"), 8, "0"))


def catalog_pages(spark, sf):
    """One landed page per part: the vendor's entry, some rival entries, some cheaper tiers."""
    p = table(spark, sf, "part")
    size, key = F.col("p_size"), F.col("p_partkey")
    none = F.lit(None).cast("string")
    prompt = F.when(size % 13 == 0, none).when(size % 17 == 0, "-1").otherwise(per_token(size * 10))
    prices = F.struct(
        prompt.alias("prompt"),
        per_token(size * 40).alias("completion"),
        F.when(size % 2 == 0, per_token(size)).alias("input_cache_read"),
        F.when(size % 4 == 1, per_token(size)).alias("cache_read"),
        F.when(size % 5 == 0, per_token(size * 2)).alias("cache_write"),
    )

    def entry(model_id: Column) -> Column:
        name = F.when(size % 3 == 0, " ").otherwise(F.concat(F.lit("Part "), key))
        return F.struct(model_id.alias("id"), name.alias("name"), prices.alias("pricing"))

    own = entry(F.concat(F.lit("vendor-a/Model_"), key))
    rival = entry(F.concat(F.lit("vendor-b/model."), key, F.lit("-20240601")))
    tier = entry(F.concat(F.lit("vendor-a/model-"), key, F.lit(":free")))
    listed = F.array_compact(F.array(own, F.when(size % 10 == 0, rival), F.when(size % 7 == 0, tier)))
    return p.select(F.to_json(F.struct(listed.alias("data"))).alias("value"))


def used_models(spark, sf):
    """Usage rows whose models are the parts of the line items."""
    return table(spark, sf, "lineitem").select(F.concat(F.lit("MODEL_"), "l_partkey").alias("model"))


def _price_rows(df):
    return _rounded(df, PRICE_COLUMNS)


def catalog_match(spark, sf):
    catalog = L.price_catalog(catalog_pages(spark, sf))
    return P.match_catalog(local_prices(spark, sf).select("model_id"), catalog).select(
        "model_id", F.col("id").alias("catalog_id")
    )


def catalog_update(spark, sf):
    catalog = L.price_catalog(catalog_pages(spark, sf))
    return _price_rows(P.updated_prices(local_prices(spark, sf), catalog, FETCHED_AT))


def catalog_add_missing(spark, sf):
    catalog = L.price_catalog(catalog_pages(spark, sf))
    return _price_rows(P.added_prices(used_models(spark, sf), local_prices(spark, sf), catalog, FETCHED_AT))


def _refreshed(spark, sf):
    catalog = L.price_catalog(catalog_pages(spark, sf))
    return P.refreshed_prices(used_models(spark, sf), local_prices(spark, sf), catalog, FETCHED_AT)


def refresh_status(spark, sf):
    catalog = L.price_catalog(catalog_pages(spark, sf))
    return P.refresh_status(used_models(spark, sf), local_prices(spark, sf), catalog, FETCHED_AT)


def refresh_recost(spark, sf):
    """A catalog with one model that the price list lacks, then re-pricing with the new list."""
    region = table(spark, sf, "region").filter("r_regionkey = 1")
    prices = F.struct(per_token(F.col("r_regionkey") * 100).alias("prompt"), per_token(F.col("r_regionkey") * 300).alias("completion"))
    listed = F.array(F.struct(F.lit("lab/House-Model").alias("id"), F.col("r_name").alias("name"), prices.alias("pricing")))
    catalog = L.price_catalog(region.select(F.to_json(F.struct(listed.alias("data"))).alias("value")))
    out = refresh_and_recost(usage(spark, sf), P.seed_prices(spark), catalog, FETCHED_AT)
    totals = out["usage"].agg(F.round(F.sum("total_cost_usd"), 6).cast("double").alias("total_cost"))
    rows = {r: out[r].withColumn("one", F.lit(1)) for r in ("status", "metrics")}
    both = rows["status"].join(rows["metrics"], "one").join(totals.withColumn("one", F.lit(1)), "one")
    return both.select("catalog_models", "updated_models", "added_models", "updated", "skipped", "total_cost")


# --- benchmark points: one landed document per order ---------------------------

POINT_MODELS = ("gpt-5.6-sol", "gpt-5.5", "GPT-5.4", "glm-5.2", "", "gpt-5.6-terra", "gpt-5.4")
POINT_EFFORTS = ("low", "medium", "high", "xhigh", "max", "ultra", "")


def point_documents(spark, sf):
    o = table(spark, sf, "orders")
    point = F.struct(
        pick(POINT_MODELS, F.col("o_custkey") % 7).alias("model"),
        pick(POINT_EFFORTS, F.col("o_orderkey") % 7).alias("effort"),
        F.when(F.col("o_orderstatus") != "P", F.floor(F.col("o_totalprice")) / 3000).alias("iq"),
        F.when(F.col("o_custkey") % 5 > 0, F.col("o_custkey") / 4 - 10).alias("average_price_usd"),
        (F.col("o_custkey") / 2 - 5).alias("average_minutes"),
        (F.col("o_orderkey") % 90).alias("total"),
    )
    board = F.concat(F.lit("board-"), F.col("o_custkey") % 3)
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    body = F.struct(board.alias("benchmark_id"), day.alias("source_updated_at"), F.array(point).alias("points"))
    return o.select("o_orderkey", F.to_json(body).alias("value"))


def points(spark, sf):
    return L.read_benchmark(point_documents(spark, sf), "o_orderkey").withColumn("point_no", F.col("o_orderkey"))


def points_valid(spark, sf):
    return points(spark, sf).select(
        "point_no",
        "model",
        "effort",
        F.round("iq", 6).alias("iq"),
        "average_price_usd",
        "average_minutes",
        "total",
        "benchmark_id",
        "document_updated_at",
    )


def heatmap(spark, sf):
    cells = B.score_heatmap(B.reliable_points(points(spark, sf)))
    return _rounded(cells, B.EFFORTS)


def headline(spark, sf):
    out = B.headline_points(B.reliable_points(points(spark, sf)))
    return out.withColumn("iq", F.round("iq", 6))


def model_price_range(spark, sf):
    models = usage(spark, sf).groupBy("model").agg(F.count("*").alias("request_count"))
    return price_ranges(models, points(spark, sf))


# --- quota section inside raw pages --------------------------------------------


def quota_pages(spark, sf):
    """Pages over https carry the section; its figures come from the page itself."""
    p = table(spark, sf, "pages")
    base = F.col("page_id") * 100 + F.length("html") + 0.25

    def usd(amount: Column) -> Column:
        return F.concat(F.lit("$"), F.format_number(amount, 2))

    def tier(plan: str, amount: Column, source: str) -> Column:
        return F.concat(
            F.lit(f"<strong>{plan}</strong>\n <span>"), usd(amount), F.lit(f"</span> <em>{source}</em>")
        )

    def history(day: str, amount: Column) -> Column:
        return F.concat(F.lit(f"<title>{day} 20x Pro 7d "), usd(amount), F.lit("</title>"))

    section = F.concat(
        F.lit('<SECTION id="q" class="panel quota-radar wide" data-x="1">\n<h2>额度雷达 <span> update '),
        F.col("page_id").cast("string"),
        F.lit("&nbsp;</span></h2>"),
        tier("20x Pro", base, "seen &amp; counted"),
        tier("5x&nbsp;Pro", base / 4, "it&#39;s derived"),
        tier("Plus", base / 20, "derived"),
        history("2026-08-03", base + 100),
        history("2026-08-06", base * 2),
        history("2026-08-09", base),
        F.lit("</SECTION><section class='quota-radar'>decoy</section>"),
    )
    secure = F.col("url").startswith("https")
    return p.select("page_id", F.when(secure, F.concat("html", section)).otherwise(F.col("html")).alias("html"))


def _sections(spark, sf):
    return L.complete_sections(L.quota_sections(quota_pages(spark, sf), "page_id"))


def page_section(spark, sf):
    return _sections(spark, sf).select("page_id", "source_updated_at", F.length("section").alias("n"))


def quota_tiers(spark, sf):
    tiers = L.quota_tiers(_sections(spark, sf), "page_id")
    return B.sorted_tiers(tiers, "page_id").select(
        "page_id", "tier_no", "plan", F.round("weekly_usd", 2).alias("weekly_usd"), "source", "plan_rank"
    )


def quota_change(spark, sf):
    return B.history_change(L.quota_history(_sections(spark, sf), "page_id"), ["page_id"])


QUERIES = {
    "price_lookup": price_lookup,
    "price_lookup_normalized": price_lookup_normalized,
    "cost_breakdown": cost_breakdown,
    "recost_all": recosted,
    "recost_zero": lambda s, d: recosted(s, d, only_zero=True),
    "recost_metrics": recost_metrics,
    "catalog_match": catalog_match,
    "catalog_update": catalog_update,
    "catalog_add_missing": catalog_add_missing,
    "price_list": lambda s, d: P.price_list(_price_rows(_refreshed(s, d))),
    "price_cache_summary": lambda s, d: P.price_cache_summary(_refreshed(s, d)),
    "price_refresh_status": refresh_status,
    "refresh_recost": refresh_recost,
    "benchmark_points_valid": points_valid,
    "benchmark_heatmap": heatmap,
    "benchmark_headline": headline,
    "model_price_range": model_price_range,
    "page_section_extract": page_section,
    "quota_tiers": quota_tiers,
    "quota_change": quota_change,
}


# --- SQL ------------------------------------------------------------------------

# the bundled prices of the models that the usage rows name, written out apart from the package
_SEED = """seed(model_id, pi, po, pr, pw) AS (
  SELECT c0, c1::DECIMAL(10,6), c2::DECIMAL(10,6), c3::DECIMAL(10,6), c4::DECIMAL(10,6) FROM (VALUES
    ('claude-sonnet-4-6', 3, 15, 0.3, 3.75), ('gpt-5.2', 1.75, 14, 0.175, 0), ('glm-5.2', 0.63, 1.98, 0.0945, 0),
    ('gpt-5.4', 2.5, 15, 0.25, 0)) AS v(c0, c1, c2, c3, c4))"""
_PRICED = f"""{WITH_USAGE}, {_SEED},
priced AS (
  SELECT u.*, COALESCE(a.model_id, b.model_id) AS priced_as,
         COALESCE(a.pi, b.pi) AS pi, COALESCE(a.po, b.po) AS po, COALESCE(a.pr, b.pr) AS pr,
         COALESCE(a.pw, b.pw) AS pw,
         CASE WHEN app_type IN ('codex', 'gemini', 'grokbuild', 'zcode')
              THEN GREATEST(input_tokens - cache_read_tokens - cache_creation_tokens, 0)
              ELSE input_tokens END AS billable
  FROM u LEFT JOIN seed a ON lower(a.model_id) = lower(u.model)
  LEFT JOIN seed b ON regexp_matches(u.model, '-[0-9]{{8}}$')
                  AND lower(b.model_id) = lower(left(u.model, length(u.model) - 9))
),
new AS (
  SELECT *, COALESCE({sql_cost('billable', 'pi')}, 0) AS n1, COALESCE({sql_cost('output_tokens', 'po')}, 0) AS n2,
         COALESCE({sql_cost('cache_read_tokens', 'pr')}, 0) AS n3,
         COALESCE({sql_cost('cache_creation_tokens', 'pw')}, 0) AS n4
  FROM priced
)"""
_COSTS = ("input_cost_usd", "output_cost_usd", "cache_read_cost_usd", "cache_creation_cost_usd")


def _recost_sql(extra: str) -> str:
    candidate = f"(data_source <> 'proxy'{extra})"
    change = f"({candidate} AND priced_as IS NOT NULL)"
    cells = [f"{money(f'CASE WHEN {change} THEN n{i} ELSE {c} END')} AS {c}" for i, c in enumerate(_COSTS, 1)]
    total = money(f"CASE WHEN {change} THEN n1 + n2 + n3 + n4 ELSE total_cost_usd END")
    return f"""{_PRICED} SELECT request_id, CASE WHEN {change} THEN 'updated' WHEN {candidate} THEN 'skipped' END
AS recost_status, {', '.join(cells)}, {total} AS total_cost_usd FROM new"""


_CATALOG = """WITH local AS (
  SELECT 'model-' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '-20250101' ELSE '' END AS model_id,
         'Model ' || p_partkey AS display_name, p_size AS i, p_size * 4 AS o, p_partkey
  FROM part WHERE p_type <> 'SMALL'
),
entries AS (
  SELECT 'vendor-a/Model_' || p_partkey AS id, p_partkey, p_size FROM part
  UNION ALL SELECT 'vendor-b/model.' || p_partkey || '-20240601', p_partkey, p_size FROM part WHERE p_size % 10 = 0
),
keyed AS (SELECT *, replace(replace(lower(regexp_replace(id, '^.*/', '')), '_', '-'), '.', '-') AS key FROM entries),
cat AS (SELECT *, regexp_replace(key, '-[0-9]{8}$', '') AS bare FROM keyed),
wanted AS (SELECT DISTINCT 'MODEL_' || l_partkey AS model_id, 'model-' || l_partkey AS key FROM lineitem),
asked AS (
  SELECT model_id, model_id AS key, regexp_replace(model_id, '-[0-9]{8}$', '') AS bare FROM local
  UNION ALL SELECT model_id, key, key FROM wanted
),
hit AS (
  SELECT model_id, MIN(id) AS id, MIN(p_partkey) AS p_partkey, MIN(p_size) AS s FROM (
    SELECT a.model_id, c.id, c.p_partkey, c.p_size FROM asked a JOIN cat c ON a.bare = c.bare)
  GROUP BY model_id HAVING COUNT(*) = 1
),
live AS (
  SELECT model_id, p_partkey, s, s * 0.1 AS pi, s * 0.4 AS po,
         CASE WHEN s % 2 = 0 OR s % 4 = 1 THEN s * 0.01 END AS pr, CASE WHEN s % 5 = 0 THEN s * 0.02 END AS pw
  FROM hit WHERE s % 13 <> 0 AND s % 17 <> 0
)"""
_AS_PRICES = """ROUND(CAST({} AS DOUBLE), 6) AS input_cost_per_million,
  ROUND(CAST({} AS DOUBLE), 6) AS output_cost_per_million, ROUND(CAST({} AS DOUBLE), 6) AS cache_read_cost_per_million,
  ROUND(CAST({} AS DOUBLE), 6) AS cache_creation_cost_per_million"""
_UPDATED = f"""updated AS (SELECT local.model_id, display_name,
  {_AS_PRICES.format('pi', 'po', 'COALESCE(pr, 0.1)', 'COALESCE(pw, 0.25)')},
  'OpenRouter live' AS price_source, {FETCHED_AT}::BIGINT AS price_fetched_at FROM local JOIN live USING (model_id))"""
_ADDED = f"""added AS (SELECT live.model_id,
  CASE WHEN s % 3 = 0 THEN live.model_id ELSE 'Part ' || p_partkey END AS display_name,
  {_AS_PRICES.format('pi', 'po', 'COALESCE(pr, 0)', 'COALESCE(pw, 0)')},
  'OpenRouter live' AS price_source, {FETCHED_AT}::BIGINT AS price_fetched_at
  FROM live JOIN wanted USING (model_id)
  WHERE p_partkey NOT IN (SELECT p_partkey FROM local))"""
_LISTED = f"""listed AS (SELECT * FROM updated UNION ALL SELECT * FROM added
  UNION ALL SELECT model_id, display_name, {_AS_PRICES.format('i', 'o', '0.1', '0.25')}, 'Built-in fallback', NULL
  FROM local WHERE model_id NOT IN (SELECT model_id FROM updated))"""
_REFRESH = f"{_CATALOG}, {_UPDATED}, {_ADDED}, {_LISTED}"

_POINTS = f"""WITH raw_points AS (
  SELECT o_orderkey AS point_no, {sql_case('o_custkey % 7', POINT_MODELS)} AS model,
         {sql_case('o_orderkey % 7', POINT_EFFORTS)} AS effort,
         CASE WHEN o_orderstatus <> 'P' THEN floor(o_totalprice) / 3000 END AS iq,
         CASE WHEN o_custkey % 5 > 0 THEN o_custkey / 4 - 10 END AS price, o_custkey / 2 - 5 AS minutes,
         o_orderkey % 90 AS total, 'board-' || (o_custkey % 3) AS benchmark_id,
         strftime(o_orderdate, '%Y-%m-%d') AS document_updated_at
  FROM orders
),
valid AS (
  SELECT point_no, model, effort, iq, CASE WHEN price >= 0 THEN price END AS average_price_usd,
         CASE WHEN minutes >= 0 THEN minutes END AS average_minutes, total, benchmark_id, document_updated_at
  FROM raw_points WHERE iq BETWEEN 0 AND 150 AND model <> '' AND effort <> '' AND total > 0
),
reliable AS (SELECT * FROM valid WHERE model LIKE 'gpt-%' AND total >= 30)"""

_PAGES = """WITH p AS (SELECT page_id, page_id * 100 + length(html) + 0.25 AS base FROM pages WHERE url LIKE 'https%')"""

ORACLES = {
    "price_lookup": f"""{_PRICED} SELECT model, priced_as, COUNT(*) AS request_count,
  MAX(pi)::DOUBLE AS input_cost_per_million, MAX(po)::DOUBLE AS output_cost_per_million,
  MAX(pr)::DOUBLE AS cache_read_cost_per_million, MAX(pw)::DOUBLE AS cache_creation_cost_per_million
FROM priced GROUP BY model, priced_as""",
    "price_lookup_normalized": f"""{_PRICED}
SELECT model, COALESCE(priced_as, CASE WHEN model = 'openai/gpt-5.4' THEN 'gpt-5.4' END) AS priced_as,
  COUNT(*) AS request_count FROM priced GROUP BY 1, 2""",
    "cost_breakdown": f"""{_PRICED} SELECT request_id,
  {', '.join(f"{money(f'n{i}')} AS {c}" for i, c in enumerate(_COSTS, 1))},
  {money('n1 + n2 + n3 + n4')} AS total_cost_usd FROM new""",
    "recost_all": _recost_sql(""),
    "recost_zero": _recost_sql(" AND total_cost_usd = 0"),
    "recost_metrics": f"""{_PRICED} SELECT COUNT(priced_as) AS updated, COUNT(*) - COUNT(priced_as) AS skipped
FROM new WHERE data_source <> 'proxy' AND total_cost_usd = 0""",
    "catalog_match": f"{_CATALOG} SELECT model_id, id AS catalog_id FROM hit JOIN local USING (model_id)",
    "catalog_update": f"{_CATALOG}, {_UPDATED} SELECT * FROM updated",
    "catalog_add_missing": f"{_CATALOG}, {_ADDED} SELECT * FROM added",
    "price_list": f"{_REFRESH} SELECT * FROM listed ORDER BY model_id",
    "price_cache_summary": f"""{_REFRESH} SELECT COUNT(*) AS model_count,
  COUNT(*) FILTER (WHERE price_source = 'OpenRouter live') AS live_models,
  COUNT(*) FILTER (WHERE price_source <> 'OpenRouter live') AS fallback_models,
  COALESCE(MAX(price_fetched_at), 0) AS latest_fetched_at FROM listed""",
    "price_refresh_status": f"""{_REFRESH} SELECT 'OpenRouter live' AS source, {FETCHED_AT}::BIGINT AS fetched_at,
  (SELECT COUNT(*) FROM entries) + (SELECT COUNT(*) FROM part WHERE p_size % 7 = 0) AS catalog_models,
  (SELECT COUNT(*) FROM updated) AS updated_models, (SELECT COUNT(*) FROM added) AS added_models,
  (SELECT COUNT(*) FROM updated) + (SELECT COUNT(*) FROM added) AS matched_models""",
    "refresh_recost": f"""{_PRICED}, again AS (
  SELECT *, CASE WHEN model = 'house-model' THEN {sql_cost('billable', '1')} + {sql_cost('output_tokens', '3')}
    ELSE n1 + n2 + n3 + n4 END AS now, priced_as IS NOT NULL OR model = 'house-model' AS found FROM new)
SELECT 1::BIGINT AS catalog_models, 0::BIGINT AS updated_models, 1::BIGINT AS added_models,
  COUNT(*) FILTER (WHERE data_source <> 'proxy' AND found) AS updated, COUNT(*) FILTER (WHERE data_source <> 'proxy' AND NOT found) AS skipped,
  {money("SUM(CASE WHEN data_source <> 'proxy' AND found THEN now ELSE total_cost_usd END)")} AS total_cost FROM again""",
    "benchmark_points_valid": f"""{_POINTS} SELECT point_no, model, effort, ROUND(iq, 6) AS iq, average_price_usd,
  average_minutes, total, benchmark_id, document_updated_at FROM valid""",
    "benchmark_heatmap": f"""{_POINTS} SELECT model,
  CASE model WHEN 'gpt-5.6-sol' THEN 0 WHEN 'gpt-5.6-terra' THEN 1 WHEN 'gpt-5.6-luna' THEN 2
             WHEN 'gpt-5.5' THEN 3 ELSE 4 END AS model_rank,
  {', '.join(f"ROUND(arg_max(iq, point_no) FILTER (WHERE effort = '{e}'), 6) AS {e}" for e in B.EFFORTS)}
FROM reliable GROUP BY model""",
    "benchmark_headline": f"""{_POINTS}
(SELECT 'strongest' AS pick, model, effort, ROUND(iq, 6) AS iq, average_price_usd FROM reliable
 ORDER BY reliable.iq DESC, point_no LIMIT 1)
UNION ALL
(SELECT 'best_value', model, effort, ROUND(iq, 6), average_price_usd FROM reliable
 WHERE reliable.iq >= 90 AND average_price_usd IS NOT NULL ORDER BY average_price_usd, point_no LIMIT 1)""",
    "model_price_range": f"""{_POINTS}, {WITH_USAGE.removeprefix('WITH ')}, m AS (
  SELECT model, COUNT(*) AS request_count, lower(regexp_replace(model, '^.*/', '')) AS key FROM u GROUP BY model)
SELECT m.model, request_count, MIN(average_price_usd) AS low_price, MAX(average_price_usd) AS high_price
FROM m LEFT JOIN valid v ON lower(v.model) = key AND v.total >= 30 GROUP BY m.model, request_count""",
    "quota_tiers": f"""{_PAGES}
SELECT page_id, 0 AS tier_no, '20x Pro' AS plan, ROUND(base, 2) AS weekly_usd, 'seen & counted' AS source,
  2 AS plan_rank FROM p
UNION ALL SELECT page_id, 1, '5x Pro', ROUND(base / 4, 2), 'it''s derived', 1 FROM p
UNION ALL SELECT page_id, 2, 'Plus', ROUND(base / 20, 2), 'derived', 0 FROM p""",
    "quota_change": f"""{_PAGES} SELECT page_id, (base + 100)::DOUBLE AS start_usd, base::DOUBLE AS end_usd,
  -100.0::DOUBLE AS delta_usd, ROUND(-100.0::DOUBLE / (base + 100)::DOUBLE * 100, 6) AS percent FROM p""",
    "page_section_extract": f"""{_PAGES}, s AS (SELECT p.page_id, h.html, base FROM p JOIN pages h USING (page_id))
SELECT page_id, 'update ' || page_id AS source_updated_at,
  CAST(length('\n<h2>额度雷达 <span> update ' || page_id || '&nbsp;</span></h2>')
     + length('<strong>20x Pro</strong>\n <span>$' || format('{{:,.2f}}', base::DOUBLE) || '</span> <em>seen &amp; counted</em>')
     + length('<strong>5x&nbsp;Pro</strong>\n <span>$' || format('{{:,.2f}}', (base / 4)::DOUBLE) || '</span> <em>it&#39;s derived</em>')
     + length('<strong>Plus</strong>\n <span>$' || format('{{:,.2f}}', (base / 20)::DOUBLE) || '</span> <em>derived</em>')
     + 3 * length('<title>2026-08-03 20x Pro 7d $</title>')
     + length(format('{{:,.2f}}', (base + 100)::DOUBLE)) + length(format('{{:,.2f}}', (base * 2)::DOUBLE))
     + length(format('{{:,.2f}}', base::DOUBLE)) AS INTEGER) AS n
FROM s""",
}
