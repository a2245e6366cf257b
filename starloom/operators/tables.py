"""Small driver-side tables in the form asked for."""

from __future__ import annotations

FORMATS = ("astropy", "pandas", "tabulate", "rows")


def make_table(rows: list[dict], format: str = "pandas", **options):
    """rows: the list itself; the other formats need their packages. No rows: an empty table, or an empty text."""
    if format == "rows":
        return rows
    if format == "astropy":
        try:
            from astropy.table import Table
        except ImportError as e:
            raise ImportError("format 'astropy' needs astropy") from e
        return Table({k: [r[k] for r in rows] for k in rows[0]}) if rows else Table()
    if format == "pandas":
        import pandas as pd

        return pd.DataFrame(rows)
    if format == "tabulate":
        try:
            from tabulate import tabulate
        except ImportError as e:
            raise ImportError("format 'tabulate' needs tabulate") from e
        return tabulate(rows, headers="keys", **options) if rows else ""
    raise ValueError(f"format must be one of {', '.join(FORMATS)}; got {format!r}")
