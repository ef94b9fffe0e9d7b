"""The operators over the driver tables, one query each, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat,
    decontamination,
    html_extraction,
    language,
    license_scan,
    packing,
    periodic_runs,
    quality_classifier,
    quality_rules,
    simhash,
    spelling_variants,
    token_counts,
    toxicity,
)
from .common import table

#: Conversation that op5 adds, and what both of its turns say.
EXTRA_CONVERSATION = -7
EXTRA_TEXT = "</s>[INST] ok [/INST]"


def _hex_digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_units", F.size("matches").cast("bigint").alias("n_matches"), "license", "score")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    items = F.array_sort(F.transform("matches", lambda m: m["item"]))
    longest = F.coalesce(F.array_max(F.transform("matches", lambda m: m["n_words"])), F.lit(0).cast("bigint"))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size(items).cast("bigint").alias("n_items"),
        _hex_digest(F.array_join(items, ",")).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
        longest.alias("longest_match"),
    )


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise(chat.ASSISTANT)
    extra = spark.range(2).select(F.lit(EXTRA_CONVERSATION).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(EXTRA_TEXT).alias("text"))
    both = turns.unionByName(extra).withColumn("parts", chat.text_part(F.col("text"))).drop("text")
    typed = both.withColumn("parts", F.transform("parts", lambda p: F.struct(
        p["type"].alias("type"), p["text"].alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("width"),
        F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"),
    )))
    read = chat.read_back(chat.format_conversations(typed))
    turns_text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        _hex_digest(turns_text).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        _hex_digest(F.col("loss_text")).alias("loss_sha256"),
        "formatted_chars",
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.severity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling_variants.spelling_variants(table(spark, sf_dir, "documents"), typos=True)
    return found.select("word", "n", "n_near", "form", "form_n", "root")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(periodic_runs.plant_repeats(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        _hex_digest(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")).alias("runs_sha256"),
        _hex_digest(F.col("collapsed")).alias("collapsed_sha256"),
    )


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_decontamination,
        op3_simhash_dedup,
        op4_token_counts,
        op5_chat_format,
        op6_quality_rules,
        op7_packing,
        op8_toxicity,
        op9_language_id,
        op10_quality_classifier,
        op11_html_extraction,
        op12_spelling_variants,
        op13_periodic_runs,
    )
} | {"pipeline": _pipeline}

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_DECONTAMINATION_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS words FROM documents),
items AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS words FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(words), 10) AS width, array_to_string(words[i : i + least(len(words), 10) - 1], ' ') AS win
  FROM items, range(1, greatest(len(words) - 9, 1) + 1) AS q(i) WHERE len(words) > 0),
widths AS (SELECT DISTINCT width FROM windows),
places AS (
  SELECT r, i, width, array_to_string(words[i : i + width - 1], ' ') AS win
  FROM docs, widths, range(1, greatest(len(words) - width + 2, 1)) AS q(i)),
found AS (SELECT p.r, p.i, p.width, w.item FROM places p JOIN windows w ON p.width = w.width AND p.win = w.win),
hits AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM found, range(0, width) AS q(k) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM found) GROUP BY r),
runs AS (
  SELECT p.r, p.i, w.item, w.j, w.width, p.i - w.j AS diagonal
  FROM places p JOIN (
    SELECT item, i AS j, least(len(words), 10) AS width, array_to_string(words[i : i + least(len(words), 10) - 1], ' ') AS win
    FROM items, range(1, greatest(len(words) - 9, 1) + 1) AS q(i) WHERE len(words) > 0) w
  ON p.width = w.width AND p.win = w.win),
islands AS (SELECT *, j - row_number() OVER (PARTITION BY r, item, diagonal ORDER BY j) AS island FROM (SELECT DISTINCT * FROM runs)),
longest AS (
  SELECT r, max(n) AS longest_match FROM (
    SELECT r, count(*) + any_value(width) - 1 AS n FROM islands GROUP BY r, item, diagonal, island) GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(longest_match, 0)::BIGINT AS longest_match
FROM docs LEFT JOIN hits USING (r) LEFT JOIN named USING (r) LEFT JOIN longest USING (r)
"""


def _breaks(text: str) -> str:
    """Backslashes that escaping adds to a text."""
    found = [f"(length({text}) - length(replace({text}, '{c}', ''))) // {len(c)}" for c in ("\\", *chat.CONTROLS)]
    return " + ".join(found)


_CHAT_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {EXTRA_CONVERSATION}, 0, 'user', '{EXTRA_TEXT}' UNION ALL SELECT {EXTRA_CONVERSATION}, 1, '{chat.ASSISTANT}', '{EXTRA_TEXT}')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = '{chat.ASSISTANT}'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = '{chat.ASSISTANT}'), '')) AS loss_sha256,
  sum(length(role) + length(text) + {_breaks("role")} + {_breaks("text")} + {len("<||>") + 1 + len(chat.END)})::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""

ORACLES = {"op1_license_scan": license_scan.oracle(), "op2_decontamination": _DECONTAMINATION_SQL, "op5_chat_format": _CHAT_SQL}
