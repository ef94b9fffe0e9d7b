"""Figures over benchmark points and quota history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Display orders and thresholds.
EFFORTS = ("low", "medium", "high", "xhigh", "max", "ultra")
MODEL_ORDER = ("gpt-5.6-sol", "gpt-5.6-terra", "gpt-5.6-luna", "gpt-5.5")
MIN_SAMPLES = 30
GOOD_SCORE = 90


def reliable_points(points: DataFrame, prefix: str = "gpt-") -> DataFrame:
    return points.filter(F.col("model").startswith(prefix) & (F.col("total") >= MIN_SAMPLES))


def model_rank(model: Column) -> Column:
    at = F.array_position(F.array(*[F.lit(m) for m in MODEL_ORDER]), model)
    return F.when(at > 0, at - 1).otherwise(len(MODEL_ORDER)).cast("int")


def plan_rank(plan: Column) -> Column:
    return (
        F.when(plan == "Plus", 0).when(plan.startswith("5x"), 1).when(plan.startswith("20x"), 2).otherwise(3)
    )


def score_heatmap(points: DataFrame) -> DataFrame:
    """Score per model and effort, the last listed point winning, models in display order."""
    cells = points.groupBy("model").pivot("effort", list(EFFORTS)).agg(F.max_by("iq", "point_no"))
    return cells.withColumn("model_rank", model_rank(F.col("model"))).orderBy("model_rank", "model")


def headline_points(points: DataFrame) -> DataFrame:
    """The strongest point and the cheapest one that still scores well; the first listed wins ties."""
    shape = F.struct("model", "effort", "iq", "average_price_usd")
    strongest = F.min_by(shape, F.struct(-F.col("iq"), F.col("point_no")))
    fit = (F.col("iq") >= GOOD_SCORE) & F.col("average_price_usd").isNotNull()
    cheapest = F.min_by(shape, F.when(fit, F.struct("average_price_usd", "point_no")))
    out = points.agg(strongest.alias("strongest"), cheapest.alias("best_value"))
    picks = F.array(
        F.struct(F.lit("strongest").alias("pick"), F.col("strongest").alias("p")),
        F.struct(F.lit("best_value").alias("pick"), F.col("best_value").alias("p")),
    )
    return (
        out.select(F.explode(picks).alias("x"))
        .filter(F.col("x.p").isNotNull())
        .select("x.pick", "x.p.model", "x.p.effort", "x.p.iq", "x.p.average_price_usd")
    )


def sorted_tiers(tiers: DataFrame, *keys: str) -> DataFrame:
    return tiers.withColumn("plan_rank", plan_rank(F.col("plan"))).orderBy(*keys, "plan_rank", "tier_no")


def history_change(history: DataFrame, keys: list[str]) -> DataFrame:
    """First to last change per history; rows only where the first value is positive."""
    ends = history.groupBy(*keys).agg(
        F.min_by("weekly_usd", "history_no").alias("start_usd"), F.max_by("weekly_usd", "history_no").alias("end_usd")
    )
    delta = F.col("end_usd") - F.col("start_usd")
    return ends.filter(F.col("start_usd") > 0).select(
        *keys,
        "start_usd",
        "end_usd",
        F.round(delta, 6).alias("delta_usd"),
        F.round(delta / F.col("start_usd") * 100, 6).alias("percent"),
    )
