"""Text rules for labels, file names and ids."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: characters that file names must not hold.
UNSAFE = r'[<>:"/\\|?*\x00-\x1f]'


def safe_filename(name: str) -> str:
    """Unsafe characters become underscores, runs of them one; no blank or dot at the end; never empty."""
    return re.sub("_+", "_", re.sub(UNSAFE, "_", name)).rstrip(" .") or "_"


def safe_filename_column(name: Column) -> Column:
    joined = F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]', "_"), "_+", "_")
    bare = F.regexp_replace(joined, "[ .]+$", "")
    return F.when(bare == "", "_").otherwise(bare)


#: TeX commands that plot labels replace, where no further letter follows.
TEX = {"hbox": "mathrm", "le": "leq", "ge": "geq"}


def plain_tex(label: str) -> str:
    for old, new in TEX.items():
        label = re.sub(rf"\\{old}(?![A-Za-z])", lambda _, new=new: f"\\{new}", label)
    return label


def some_ids(ids: Sequence[int], most: int = 20, total: int | None = None) -> str:
    """The first ids, and how many more there are; total: their number, if only the first are given."""
    shown = ", ".join(str(i) for i in ids[:most])
    more = (len(ids) if total is None else total) - most
    return shown if more <= 0 else f"{shown}, … ({more} more)"


def last_component(name: str) -> str:
    return name.rsplit("/", 1)[-1]
