"""Column helpers that keep IEEE results where ANSI SQL would raise or give NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def ratio(a: Column, b: Column) -> Column:
    """a / b with NaN for 0/0 and signed infinity for x/0, as in floating point."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(b != 0, F.try_divide(a, b)).when(F.isnan(a) | (a == 0), F.lit(NAN)).when(a.isNull() | b.isNull(), F.lit(None).cast("double")).otherwise(F.signum(a) * F.lit(float("inf")))


def or_nan(c: Column) -> Column:
    """NULL becomes NaN: an aggregate over too few rows is not a number, rather than missing."""
    return F.coalesce(c.cast("double"), F.lit(NAN))


def or_null(c: Column) -> Column:
    """NaN becomes NULL, for output that other engines compare."""
    return F.when(~F.isnan(c), c)


def differs(a: Column, b: Column) -> Column:
    """a != b where NaN differs from everything, itself included."""
    return F.isnan(a) | F.isnan(b) | (a != b)


def step_of(value: Column, edges: list[int]) -> Column:
    """Index of the first edge that is >= value (len(edges) if none), as a balanced tree of comparisons."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value <= F.lit(edges[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(edges))
