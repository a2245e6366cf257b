"""The index of a simulation's outputs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import make_table


@dataclass(frozen=True)
class OutputMeta:
    name: str
    path: str
    index: int
    time: float | None = None
    scale_factor: float | None = None
    redshift: float | None = None
    output_type: str | None = None


def index_outputs(groups: DataFrame, root: str = "Outputs") -> DataFrame:
    """Groups (name, time, scale_factor, output_type) to the outputs among them, numbered from 1 in the order of their trailing number; without one it is 0."""
    number = F.when(F.col("name").rlike(r"^Output\d+$"), F.regexp_extract("name", r"(\d+)$", 1).cast("long")).otherwise(F.lit(0))
    order = Window.orderBy(number, "name")  # one row per output
    found = groups.where(F.col("name").startswith("Output"))
    return found.select(F.row_number().over(order).alias("index"), "name", F.concat(F.lit(f"/{root}/"), "name").alias("path"), "time", "scale_factor", F.when(F.col("scale_factor") > 0, F.try_divide(F.lit(1.0), F.col("scale_factor")) - 1).alias("redshift"), "output_type")


class OutputIndex:
    """Outputs in order; by place from 0, or by name."""

    def __init__(self, outputs: DataFrame) -> None:
        self.outputs = outputs
        self._list = [OutputMeta(r["name"], r["path"], r["index"], r["time"], r["scale_factor"], r["redshift"], r["output_type"]) for r in outputs.orderBy("index").collect()]
        self._named = {m.name: m for m in self._list}

    def __len__(self) -> int:
        return len(self._list)

    def __iter__(self) -> Iterator[OutputMeta]:
        return iter(self._list)

    def __getitem__(self, key: int | str) -> OutputMeta:
        if isinstance(key, str):
            if key not in self._named:
                raise KeyError(f"no output {key!r}; there are {', '.join(self._named)}")
            return self._named[key]
        if not -len(self._list) <= key < len(self._list):
            raise KeyError(f"no output at {key} of {len(self._list)}")
        return self._list[key]

    def table(self, format: str = "pandas"):
        fields = ("index", "name", "time", "scale_factor", "redshift", "output_type")
        return make_table([{k: asdict(m)[k] for k in fields} for m in self._list], format)
