"""Running values over an ordered group that may be too large for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import staged

CHUNK_ROWS = 1_000_000


def _chunk(order: str, chunk_rows: int) -> Column:
    return F.floor(F.col(order) / chunk_rows).cast("bigint")


def wide_groups(df: DataFrame, key: str, order: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The groups that reach over more than one range of ``chunk_rows`` order values, written out.

    For ``running`` over ``df`` (one that is cheap to read), or over part of its rows in the same order.
    """
    chunk = _chunk(order, chunk_rows)
    reach = df.groupBy(key).agg(F.min(chunk).alias("_low"), F.max(chunk).alias("_high"))
    return staged(reach.filter("_low < _high").select(key), "wide-groups")


def running(
    df: DataFrame,
    keys: list[str],
    order: str,
    *,
    last: dict[str, Column] | None = None,
    last_before: dict[str, Column] | None = None,
    count: dict[str, Column] | None = None,
    total: dict[str, Column] | None = None,
    peak: dict[str, Column] | None = None,
    peak_before: dict[str, Column] | None = None,
    chunk_rows: int = CHUNK_ROWS,
    wide: DataFrame | None = None,
) -> DataFrame:
    """Add running columns per ``keys`` in ``order`` (an integer, unique per key).

    ``last``: latest non-null value up to and including the row.
    ``last_before``: the same, excluding the row.
    ``count``: how many rows so far satisfy the condition, including the row.
    ``total``: sum so far of a whole number that is never null, including the row.
    ``peak``: greatest value so far, including the row.
    ``peak_before``: the same, excluding the row.

    The group is cut into ranges of ``chunk_rows`` order values. Windows run
    inside a range, one summary row per range carries the state forward, and a
    join on (keys, range) adds it back. A group with a third of all rows is so
    spread over many tasks; only its range summaries meet in one.
    ``wide``, from ``wide_groups`` by the first of ``keys``, names the groups that have more
    than one range: no other is summarised, and none at all if there are none.
    """
    last, last_before, peak, peak_before = last or {}, last_before or {}, peak or {}, peak_before or {}
    count = {n: F.coalesce(c, F.lit(False)).cast("bigint") for n, c in (count or {}).items()} | {n: c.cast("bigint") for n, c in (total or {}).items()}
    source = df.withColumns(
        {
            "_chunk": _chunk(order, chunk_rows),
            **{f"_v_{n}": c for n, c in {**last, **last_before}.items()},
            **{f"_c_{n}": c for n, c in count.items()},
            **{f"_p_{n}": c for n, c in {**peak, **peak_before}.items()},
        }
    )
    part = [*keys, "_chunk"]
    upto = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)

    within = source.withColumns(
        {
            **{n: F.last(f"_v_{n}", ignorenulls=True).over(upto) for n in last},
            **{n: F.last(f"_v_{n}", ignorenulls=True).over(before) for n in last_before},
            **{n: F.sum(f"_c_{n}").over(upto) for n in count},
            **{n: F.max(f"_p_{n}").over(upto) for n in peak},
            **{n: F.max(f"_p_{n}").over(before) for n in peak_before},
        }
    )

    values, peaks = [*last, *last_before], [*peak, *peak_before]
    if wide is not None:
        if wide.isEmpty():
            return within.select(*df.columns, *values, *count, *peaks)
        source = source.join(wide.toDF(keys[0]), keys[0], "left_semi")
    summary = source.groupBy(*part).agg(
        *[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col(order))).alias(f"_s_{n}") for n in values],
        *[F.sum(f"_c_{n}").alias(f"_s_{n}") for n in count],
        *[F.max(f"_p_{n}").alias(f"_s_{n}") for n in peaks],
    )
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        *part,
        *[F.last(f"_s_{n}", ignorenulls=True).over(earlier).alias(f"_k_{n}") for n in values],
        *[F.sum(f"_s_{n}").over(earlier).alias(f"_k_{n}") for n in count],
        *[F.max(f"_s_{n}").over(earlier).alias(f"_k_{n}") for n in peaks],
    ).filter(F.col("_chunk") > 0)

    joined = within.join(carry, part, "left")
    merged = joined.withColumns(
        {
            **{n: F.coalesce(F.col(n), F.col(f"_k_{n}")) for n in values},
            **{n: F.col(n) + F.coalesce(F.col(f"_k_{n}"), F.lit(0)) for n in count},
            **{n: F.greatest(F.col(n), F.col(f"_k_{n}")) for n in peaks},
        }
    )
    return merged.select(*df.columns, *values, *count, *peaks)
