"""The daily rollup as a stored table that follows the fact table.

What lands on a day changes the cells of that day, and, as a proxy record may arrive
after the session record that it hides, those of days within the window. Only those
days are read and folded again; cells that are not there any more go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.analytics import daily_rollup
from ..operators.dedup import days_around, effective_days
from ..schema import DEDUP_WINDOW_SECONDS, USAGE_SCHEMA
from ..session import staged
from ..streaming.tables import VersionedTable

CELL = ["date", "app_type", "provider_id", "model", "request_model", "pricing_model"]


def rollup_table(spark: SparkSession, path: str) -> VersionedTable:
    cells = daily_rollup(spark.createDataFrame([], USAGE_SCHEMA)).schema
    nullable = T.StructType([T.StructField(f.name, f.dataType) for f in cells])
    return VersionedTable(spark, path, nullable).keyed(CELL, by=["date"])


def refresh_rollup(table: VersionedTable, fact: DataFrame, landed: DataFrame, batch: int) -> None:
    """Bring the cells of the days around the rows that have ``landed`` in ``fact`` up to date, as one batch's change."""
    days = days_around(landed, DEDUP_WINDOW_SECONDS)
    # rows without a day have a cell of their own, always folded again
    dates = days.select(F.col("_day").cast("string").alias("date")).unionByName(days.sparkSession.range(1).select(F.lit(None).cast("string").alias("date"))).distinct()
    new = staged(daily_rollup(effective_days(fact, days)), "rollup-cells")
    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in CELL]
    old = table.before(batch, only=dates).alias("o")
    touched = old.join(dates.alias("d"), F.col("o.date").eqNullSafe(F.col("d.date")), "left_semi")
    gone = touched.alias("o").join(new.alias("n"), same, "left_anti")
    table.change(batch, new.withColumn("_gone", F.lit(False)).unionByName(gone.withColumn("_gone", F.lit(True))))
