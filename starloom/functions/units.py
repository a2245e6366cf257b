"""Units as column metadata, and conversion between the common ones."""

from __future__ import annotations

import warnings
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Units in SI and what they measure.
UNITS = {
    "kg": (1.0, "mass"),
    "g": (1.0e-3, "mass"),
    "solMass": (1.98892e30, "mass"),
    "m": (1.0, "length"),
    "km": (1.0e3, "length"),
    "pc": (3.0856775814913673e16, "length"),
    "kpc": (3.0856775814913673e19, "length"),
    "Mpc": (3.0856775814913673e22, "length"),
    "s": (1.0, "time"),
    "yr": (3.15576e7, "time"),
    "Myr": (3.15576e13, "time"),
    "Gyr": (3.15576e16, "time"),
    "m/s": (1.0, "speed"),
    "km/s": (1.0e3, "speed"),
}
KEY = "units"


@dataclass(frozen=True)
class Units:
    in_si: float = 1.0
    description: str = ""
    quantity: str = ""
    is_comoving: int = 0


def units_of(raw: dict | float | None) -> Units | None:
    """From a stored attribute: a record with unitsInSI, description, quantity, isComoving, or a number alone. Values that cannot be read become 1.0 and 0."""
    if raw is None:
        return None

    def number(x: object, kind: type, default: float) -> float:
        try:
            return kind(x)
        except (TypeError, ValueError):
            return default

    if isinstance(raw, dict):
        text = lambda x: x.decode("utf-8", "replace") if isinstance(x, bytes) else str(x or "")
        return Units(number(raw.get("unitsInSI"), float, 1.0), text(raw.get("description")), text(raw.get("quantity")), int(number(raw.get("isComoving"), int, 0)))
    return Units(number(raw, float, 1.0))


def with_units(df: DataFrame, column: str, units: Units | None) -> DataFrame:
    """Keeps the units in the column's metadata; an unknown quantity is kept and warned of."""
    if units is None:
        return df
    if units.quantity and units.quantity not in UNITS:
        warnings.warn(f"unknown unit {units.quantity!r} of column {column!r}: values are as stored", UserWarning, stacklevel=2)
    return df.withMetadata(column, {**df.schema[column].metadata, KEY: asdict(units)})


def column_units(df: DataFrame, column: str) -> Units | None:
    kept = df.schema[column].metadata.get(KEY)
    return Units(**kept) if kept else None


def convert_units(df: DataFrame, column: str, to: str) -> DataFrame:
    """The column in another unit of the same kind, and its metadata with it."""
    have = column_units(df, column)
    if have is None or have.quantity not in UNITS:
        raise ValueError(f"column {column!r} has no known unit")
    if to not in UNITS or UNITS[to][1] != UNITS[have.quantity][1]:
        raise ValueError(f"cannot convert {have.quantity!r} to {to!r}")
    factor = UNITS[have.quantity][0] / UNITS[to][0]
    return with_units(df.withColumn(column, F.col(column) * F.lit(factor)), column, Units(UNITS[to][0], have.description, to, have.is_comoving))
