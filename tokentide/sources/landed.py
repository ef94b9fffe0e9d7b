"""Landed catalog, benchmark and quota documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.money import decode_text, parse_usd
from ..session import staged

_CATALOG = """data array<struct<id:string,name:string,pricing:struct<prompt:string,completion:string,
input_cache_read:string,cache_read:string,input_cache_write:string,cache_write:string>>>"""

_POINTS = """source_updated_at string, benchmark_id string, score_label string, runs_24h_total bigint,
runs_total bigint, points array<struct<model:string,effort:string,iq:double,average_price_usd:double,
average_minutes:double,total:bigint,runs_24h:bigint,runs_total:bigint,source_updated_at:string>>"""


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """Fail the job when a document yields nothing."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def price_catalog(documents: DataFrame) -> DataFrame:
    """Catalog entries (entry_no, id, name, four price texts) from (value).

    Entry numbers are unique over all documents, so that same-named entries of
    different pages still count as two.
    """
    parsed = documents.select(F.from_json("value", _CATALOG).alias("d"))
    entry = F.col("e")
    return (
        parsed.select(F.explode("d.data").alias("e"))
        .withColumn("entry_no", F.monotonically_increasing_id())
        .select(
            "entry_no",
            entry["id"].alias("id"),
            entry["name"].alias("name"),
            entry["pricing"]["prompt"].alias("prompt"),
            entry["pricing"]["completion"].alias("completion"),
            F.coalesce(entry["pricing"]["input_cache_read"], entry["pricing"]["cache_read"]).alias("cache_read"),
            F.coalesce(entry["pricing"]["input_cache_write"], entry["pricing"]["cache_write"]).alias("cache_write"),
        )
    )


# Fields of a benchmark document beside its points, by the name their column gets.
_HEADER = {
    "benchmark_id": "benchmark_id",
    "score_label": "score_label",
    "document_updated_at": "source_updated_at",
    "document_runs_24h": "runs_24h_total",
    "document_runs_total": "runs_total",
}


def benchmark_points(documents: DataFrame, *keys: str) -> DataFrame:
    """All points of the landed documents with their place in them and their document's header, before validation."""
    parsed = documents.select(*keys, F.from_json("value", _POINTS).alias("d"))
    header = [F.col(f"d.{field}").alias(name) for name, field in _HEADER.items()]
    return parsed.select(*keys, *header, F.posexplode("d.points").alias("point_no", "p")).select(
        *keys, "point_no", "p.*", *_HEADER
    )


def read_benchmark(documents: DataFrame, *keys: str) -> DataFrame:
    """Valid points of landed documents; without a single one the load fails."""
    points = staged(valid_points(benchmark_points(documents, *keys)), "benchmark")
    return require_rows(points, "no valid benchmark point")


def valid_points(points: DataFrame) -> DataFrame:
    """Points with a score of 0 to 150, a model, an effort and samples; bad side values become NULL."""

    def sane(c: str) -> Column:
        return F.when((F.col(c) >= 0) & (F.col(c) < float("inf")), F.col(c))

    good = (
        F.col("iq").between(0.0, 150.0)
        & (F.coalesce("model", F.lit("")) != "")
        & (F.coalesce("effort", F.lit("")) != "")
        & (F.coalesce("total", F.lit(0)) > 0)
    )
    return points.filter(good).withColumns(
        {"average_price_usd": sane("average_price_usd"), "average_minutes": sane("average_minutes")}
    )


# Fixed patterns: markup of the quota section.
_SECTION = r"""(?is)<section[^>]*class="[^"]*\bquota-radar\b[^"]*"[^>]*>(.*?)</section>"""
_UPDATED = r"(?is)额度雷达\s*<span>([^<]+)</span>"
_TIER = r"(?is)<strong>([^<]+)</strong>\s*<span>\$([0-9,]+(?:\.[0-9]+)?)</span>\s*<em>([^<]+)</em>"
_HISTORY = r"(?is)<title>([^<]+?)\s+20x Pro 7d\s+\$([0-9,]+(?:\.[0-9]+)?)</title>"


def quota_sections(pages: DataFrame, *keys: str) -> DataFrame:
    """(keys, section, source_updated_at) of pages that have the section."""
    found = pages.filter(F.col("html").rlike(_SECTION))
    section = F.regexp_extract("html", _SECTION, 1)
    return found.select(*keys, section.alias("section")).withColumn(
        "source_updated_at", decode_text(F.regexp_extract("section", _UPDATED, 1))
    )


def _repeated(sections: DataFrame, pattern: str, number: str, groups: dict[str, int], *keys: str) -> DataFrame:
    """Rows of every match of a pattern; each group is extracted over the whole section."""
    lists = [F.regexp_extract_all("section", F.lit(pattern), F.lit(g)).alias(n) for n, g in groups.items()]
    zipped = sections.select(*keys, F.arrays_zip(*lists).alias("_z"))
    return zipped.select(*keys, F.posexplode("_z").alias(number, "_m")).select(*keys, number, "_m.*")


def complete_sections(sections: DataFrame) -> DataFrame:
    """Sections that name at least one tier; a section without any is rejected."""
    return sections.filter(F.col("section").rlike(_TIER))


def quota_tiers(sections: DataFrame, *keys: str) -> DataFrame:
    """(keys, tier_no, plan, weekly_usd, source)."""
    rows = _repeated(sections, _TIER, "tier_no", {"plan": 1, "usd": 2, "source": 3}, *keys)
    return rows.select(
        *keys,
        "tier_no",
        decode_text(F.col("plan")).alias("plan"),
        parse_usd(F.col("usd")).alias("weekly_usd"),
        decode_text(F.col("source")).alias("source"),
    ).filter("weekly_usd is not null")


def quota_history(sections: DataFrame, *keys: str) -> DataFrame:
    """(keys, history_no, label, weekly_usd)."""
    rows = _repeated(sections, _HISTORY, "history_no", {"label": 1, "usd": 2}, *keys)
    return rows.select(
        *keys,
        "history_no",
        decode_text(F.col("label")).alias("label"),
        parse_usd(F.col("usd")).alias("weekly_usd"),
    ).filter("weekly_usd is not null")
