"""Typed reads from JSON log text.

Log fields are schema-on-read: a field of the wrong JSON type counts as absent.
from_json with an explicit schema already works so for numbers, flags, objects
and arrays, but hands out the raw text of anything under a string field. Texts
whose type matters, and keys whose mere presence matters, are therefore declared
VARIANT and read with the helpers below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .tokens import clamp


def parsed(df: DataFrame, text: str, schema: str, *keep: str) -> DataFrame:
    """``keep`` plus the parsed text as ``j``, each text parsed exactly once."""
    return computed(df, list(keep), {"j": F.from_json(text, schema)})


def computed(df: DataFrame, keep: list[str], columns: dict[str, Column]) -> DataFrame:
    """``keep`` plus derived columns that later filters must not evaluate again.

    A filter moves below a plain projection and takes copies of its expressions
    along; it does not move below a generator.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*keep, F.inline(F.array(row)))


def text(v: Column) -> Column:
    """Text of a VARIANT that holds a JSON string."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def integer(v: Column) -> Column:
    return F.when(F.schema_of_variant(v) == "BIGINT", F.try_variant_get(v, "$", "bigint"))


def field(v: Column, name: str) -> Column:
    """A key of a VARIANT object, a VARIANT itself."""
    return F.try_variant_get(v, f"$.{name}", "variant")


def count(value: Column) -> Column:
    """A non-negative number, else NULL."""
    return F.when(value >= 0, value)


def count_or_zero(value: Column) -> Column:
    """A token count from a log, within the range of a count; 0 when absent or negative.

    Counts above the range are clamped, in every source alike, so that one bad
    record cannot overflow a sum or a price (a 32-bit store would wrap instead).
    """
    return clamp(F.coalesce(value, F.lit(0).cast("bigint")))
