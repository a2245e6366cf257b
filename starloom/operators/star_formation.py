"""Star-formation histories: sums over metallicity of nested arrays, and the times they belong to."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import right_aligned, sum_rows, widest
from ..functions.numeric import NAN


def parse_times(raw: str | list | None) -> list[float] | None:
    """Times of an attribute: a list, or text such as [1.0, 2.0]."""
    if raw is None:
        return None
    if not isinstance(raw, str):
        return [float(x) for x in raw]
    return [float(x) for x in re.split(r"[\s,]+", raw.strip().strip("[]").strip()) if x]


def collapse(df: DataFrame, column: str, times: list[float] | None = None, fixed_ages: bool = False) -> DataFrame:
    """Sums the inner arrays of a column, in one of three forms.

    With times of its own the history has their length, and an empty one is zeros. With fixed ages histories
    are right-aligned to the longest, zeros in front. Else they stay ragged. Own times win over fixed ages.
    """
    if times is not None:
        return df.withColumn(column, sum_rows(F.col(column), len(times)))
    out = df.withColumn(column, sum_rows(F.col(column)))
    return right_aligned(out, column, 0.0) if fixed_ages else out


def times(df: DataFrame, column: str | None, own: list[float] | None = None, fixed_ages: bool = False) -> list[float] | DataFrame | None:
    """The times themselves if the dataset has them; with fixed ages the companion column, right-aligned with NaN in front; else none."""
    if own is not None:
        return own
    if not fixed_ages or column is None:
        return None
    return right_aligned(df, column, NAN, widest(df, column))


def companion(name: str) -> str:
    if not name.endswith("Mass"):
        raise ValueError(f"{name!r} is no star-formation history mass")
    return f"{name[:-4]}Times"


def _marks(dataset) -> tuple[list[float] | None, bool]:
    collection = dataset.collection
    ages = collection.attributes("Parameters/starFormationHistory")
    return parse_times(dataset.attrs.get("time")), {"countAges", "ageMinimum"} <= set(ages)


def sfh_collapse_metallicities(dataset) -> DataFrame:
    """The dataset's rows with their histories summed over metallicity; column `value`."""
    own, fixed = _marks(dataset)
    return collapse(dataset.rows(), "value", own, fixed)


def sfh_times(dataset) -> list[float] | DataFrame | None:
    own, fixed = _marks(dataset)
    if own is not None or not fixed:
        return own
    name = companion(dataset.column)
    other = dataset.sibling(name)
    return None if other is None else times(other.rows(), "value", None, True)
