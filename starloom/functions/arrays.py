"""Nested and ragged arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sum_rows(nested: Column, width: Column | int | None = None) -> Column:
    """Element-wise sum of the inner arrays. An empty outer array gives `width` zeros, or an empty array without a width.

    Inner arrays of different lengths are an error.
    """
    zero = F.array_repeat(F.lit(0.0), width if isinstance(width, int) else width.cast("int")) if width is not None else F.array().cast("array<double>")
    even = F.forall(nested, lambda r: F.size(r) == F.size(F.element_at(nested, 1)))
    total = F.aggregate(F.slice(nested, 2, F.greatest(F.size(nested) - 1, F.lit(0))), F.element_at(nested, 1).cast("array<double>"), lambda acc, r: F.zip_with(acc, r, lambda a, b: a + b))
    return F.when(nested.isNull(), F.lit(None)).when(F.size(nested) == 0, zero).when(even, total).otherwise(F.raise_error(F.lit("inner arrays differ in length")).cast("array<double>"))


def padded_front(values: Column, width: int, fill: float) -> Column:
    """Right-aligned to a width by filling at the front."""
    return F.concat(F.array_repeat(F.lit(float(fill)), F.greatest(F.lit(width) - F.size(values), F.lit(0))), values)


def widest(df: DataFrame, column: str) -> int:
    """Length of the longest array of a column, 0 without rows: one small aggregate."""
    return max(0, df.agg(F.max(F.size(column))).first()[0] or 0)


def right_aligned(df: DataFrame, column: str, fill: float, width: int | None = None) -> DataFrame:
    return df.withColumn(column, padded_front(F.coalesce(F.col(column), F.array().cast("array<double>")), widest(df, column) if width is None else width, fill))


def long_form(df: DataFrame, keys: list[str], column: str, position: str = "i", value: str = "value") -> DataFrame:
    return df.select(*keys, F.posexplode(column).alias(position, value))
