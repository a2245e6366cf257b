"""Files of a simulation as one table per output, and several such models side by side."""

from __future__ import annotations

import functools
import numbers
import warnings
from collections.abc import Iterator, Mapping, Sequence
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.units import Units, column_units, with_units
from ..sources import discovery, hdf5, store
from . import analyses as an
from . import history
from .outputs import OutputIndex
from .reading import PLACE, ROW, column_of, read, select_rows, take
from .tables import make_table


def incomplete_files(files: DataFrame) -> DataFrame:
    """Files whose status is anything but 0, or missing."""
    return files.where(~F.col("status_completion").eqNullSafe(0))


class Collection:
    """One or many files, read one after the other. Metadata come from the first file."""

    def __init__(self, spark: SparkSession, files: Sequence[str], output_root: str = "Outputs") -> None:
        self.spark, self.files, self.output_root = spark, list(files), output_root
        self._stores = all(store.is_store(f) for f in self.files)

    # metadata
    @functools.cached_property
    def _described(self) -> dict:
        return hdf5.describe(self.files[0], self.output_root)

    def _meta(self, name: str, schema: str) -> DataFrame:
        if self._stores:
            return store.table(self.spark, self.files[0], name, schema)
        return self.spark.createDataFrame(self._described[name] or [], schema)

    @functools.cached_property
    def outputs(self) -> OutputIndex:
        return OutputIndex(self._meta("outputs", store.OUTPUTS))

    @functools.cached_property
    def properties(self) -> DataFrame:
        return self._meta("properties", store.PROPERTIES)

    @functools.cached_property
    def analyses(self) -> DataFrame:
        if self._stores:
            try:
                return store.table(self.spark, self.files[0], "analyses", store.ANALYSES)
            except Exception as e:
                if "PATH_NOT_FOUND" in str(e):
                    raise KeyError(f"{self.files[0]} has no analyses") from e
                raise
        if self._described["analyses"] is None:
            raise KeyError(f"{self.files[0]} has no analyses")
        return self.spark.createDataFrame(self._described["analyses"], store.ANALYSES)

    @functools.cached_property
    def _attributes(self) -> list:
        return self._meta("attributes", store.ATTRIBUTES).collect()

    def attributes(self, path: str) -> dict[str, str]:
        return {r["key"]: r["value"] for r in self._attributes if r["path"].strip("/") == path.strip("/")}

    def status(self) -> DataFrame:
        if self._stores:
            return store.status(self.spark, self.files)
        rows = [(i, path, hdf5.describe(path, self.output_root)["status"]) for i, path in enumerate(self.files)]
        return self.spark.createDataFrame(rows, "file_ord int, path string, status_completion int")

    def validate_completion(self, mode: str = "error") -> None:
        if mode not in ("error", "warn", "ignore"):
            raise ValueError(f"mode must be 'error', 'warn' or 'ignore'; got {mode!r}")
        if mode == "ignore":
            return
        if bad := [r["path"] for r in incomplete_files(self.status()).orderBy("file_ord").collect()]:
            message = f"incomplete files: {', '.join(bad)}"
            if mode == "error":
                raise RuntimeError(message)
            warnings.warn(message, UserWarning, stacklevel=2)

    # rows
    @functools.cached_property
    def nodes(self) -> DataFrame:
        """All outputs: output_name, file_ord, row_in_file and the properties, with their units in the columns' metadata."""
        if self._stores:
            rows = store.nodes(self.spark, self.files)
        else:
            rows = None
            for m in self.outputs:
                part = hdf5.scan(self.spark, self.files, f"{self.output_root}/{m.name}/nodeData").withColumn("output_name", F.lit(m.name))
                rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
        seen = set()
        for p in self.properties.collect():
            if p["name"] in rows.columns and p["name"] not in seen and p["units_in_si"] is not None:
                seen.add(p["name"])
                rows = with_units(rows, p["name"], Units(p["units_in_si"], p["units"] or "", p["quantity"] or "", p["is_comoving"] or 0))
        return rows

    def output(self, output: str | int) -> DataFrame:
        name = discovery.output_name(output)
        self.outputs[name]
        return self.nodes.where(F.col("output_name") == name)

    def read(self, output: str | int, datasets: Sequence[str] | Mapping[str, str], where: Column | str | Sequence | None = None) -> DataFrame:
        """The datasets (paths, or label: path) of an output; where: a condition, a mask or row numbers."""
        return read(self.output(output), datasets, where)

    def list_outputs(self, format: str = "pandas"):
        return self.outputs.table(format)

    def list_properties(self, output: str | int, format: str = "pandas"):
        name = discovery.output_name(output)
        self.outputs[name]
        rows = self.properties.where(F.col("output_name") == name).orderBy("name").collect()
        return make_table([{"name": r["name"], "dtype": r["dtype"], "shape": r["shape"], "description": r["description"] or "", "units": r["units"] or ""} for r in rows], format)

    def trace_history(self, ids: Sequence[int], properties: Sequence[str] | Mapping[str, str], outputs: Sequence[int | str] | None = None, **options) -> DataFrame:
        return history.trace_galaxy_history(self, ids, properties, outputs, **options)

    def list_analyses(self, format: str = "pandas"):
        return an.list_analyses(self, format)

    def plot_analyses(self, *args, **options) -> dict:
        return an.plot_analyses(self, *args, **options)

    # browsing
    def _paths(self) -> set[str]:
        found = {r["path"].strip("/") for r in self._attributes}
        for m in self.outputs:
            found.add(f"{self.output_root}/{m.name}/nodeData")
            found |= {f"{self.output_root}/{m.name}/nodeData/{c}" for c in self.nodes.columns if c not in ("output_name", *PLACE)}
        for path in list(found):
            found |= {path.rsplit("/", k)[0] for k in range(1, path.count("/") + 1)}
        return found

    def keys(self) -> list[str]:
        return sorted({p.split("/", 1)[0] for p in self._paths()})

    def __contains__(self, path: str) -> bool:
        return path.strip("/") in self._paths()

    def __getitem__(self, path: str) -> Group | Dataset:
        at = path.strip("/")
        if at not in self._paths():
            raise KeyError(f"nothing at {path!r}")
        parts = at.split("/")
        if len(parts) == 4 and parts[0] == self.output_root and parts[2] == "nodeData":
            return Dataset(self, parts[1], parts[3], at)
        return Group(self, at)

    def close(self) -> None:
        """Nothing stays open between jobs."""

    def __enter__(self) -> Collection:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def __repr__(self) -> str:
        return f"Collection({len(self.files)} files, {len(self.outputs)} outputs)"


class Group:
    def __init__(self, collection: Collection, path: str) -> None:
        self.collection, self.name = collection, f"/{path}"
        self._at = path

    @property
    def attrs(self) -> dict[str, str]:
        return self.collection.attributes(self._at)

    def keys(self) -> list[str]:
        return sorted({p[len(self._at) + 1 :].split("/", 1)[0] for p in self.collection._paths() if p.startswith(f"{self._at}/")})

    def __iter__(self) -> Iterator[str]:
        return iter(self.keys())

    def __contains__(self, key: str) -> bool:
        return f"{self._at}/{key}" in self.collection

    def __getitem__(self, key: str) -> Group | Dataset:
        return self.collection[f"{self._at}/{key}"]


class Dataset:
    """One property of one output."""

    def __init__(self, collection: Collection, output: str, column: str, path: str) -> None:
        self.collection, self.output, self.column, self.name = collection, output, column, f"/{path}"

    @property
    def attrs(self) -> dict[str, str]:
        return self.collection.attributes(self.name)

    @property
    def units(self) -> Units | None:
        return column_units(self.collection.nodes, self.column)

    @property
    def dtype(self) -> str:
        return self.collection.nodes.schema[self.column].dataType.simpleString()

    @property
    def shape(self) -> tuple[int, ...]:
        """The rows of all files; then the width, if there is one."""
        rows = self.rows()
        if not self.dtype.startswith("array"):
            return (rows.count(),)
        n, width = rows.agg(F.count("*"), F.max(F.size("value"))).first()
        return (n, width or 0)

    def rows(self) -> DataFrame:
        return self.collection.output(self.output).select(*PLACE, F.col(f"`{self.column}`").alias("value"))

    def read(self, where: Column | str | Sequence | None = None) -> DataFrame:
        return select_rows(self.rows(), where)

    @functools.cached_property
    def _first(self) -> tuple[DataFrame, int]:
        """The first file's rows, by a scan of that file alone, and their number."""
        c = self.collection
        rows = (c if len(c.files) == 1 else Collection(c.spark, c.files[:1], c.output_root)).output(self.output).select(*PLACE, F.col(f"`{self.column}`").alias("value"))
        return rows, rows.count()

    def __getitem__(self, selection: slice | int | Sequence) -> DataFrame:
        """Rows of the first file only, selected as from an array: by slice, number, numbers or mask. `position` is the place in the selection."""
        first, n = self._first
        row = F.col("row_in_file")
        if isinstance(selection, slice):
            asked = range(*selection.indices(n))
            low, high = (min(asked), max(asked)) if asked else (0, -1)
            place = (row - asked.start) / F.lit(asked.step)
            chosen = first.where(row.between(low, high) & ((row - asked.start) % asked.step == 0))
            return chosen.withColumn("position", place.cast("long")).orderBy("position")
        values = np.asarray([selection] if isinstance(selection, numbers.Integral) else selection)
        if values.dtype == bool:
            if len(values) != n:
                raise IndexError(f"the mask has {len(values)} values for {n} rows")
            values = np.flatnonzero(values)
        return take(first, values.tolist()).drop(ROW)

    def sibling(self, column: str) -> Dataset | None:
        return Dataset(self.collection, self.output, column, f"{self.name.rsplit('/', 1)[0].strip('/')}/{column}") if column_of(column) in self.collection.nodes.columns else None


class ModelCollection(dict):
    """Collections by label."""

    def list_analyses(self, format: str = "pandas"):
        return make_table([r.asDict() for r in an.listing_of_models(an.of_models(self)).collect()], format)

    def plot_analyses(self, *args, **options) -> dict:
        return an.plot_analyses(self, *args, **options)

    def nodes(self) -> DataFrame:
        """The rows of all models with their label."""
        out = None
        for label, c in self.items():
            part = c.nodes.withColumn("model", F.lit(label))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def close(self) -> None:
        for label, c in self.items():
            try:
                c.close()
            except Exception as e:
                warnings.warn(f"closing {label!r} failed: {e}", UserWarning, stacklevel=2)

    def __enter__(self) -> ModelCollection:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def open_models(spark: SparkSession, models: Mapping | Sequence, output_root: str = "Outputs") -> ModelCollection:
    return ModelCollection({label: Collection(spark, files, output_root) for label, files in discovery.labelled(models).items()})


def open_outputs(spark: SparkSession, path: str | Path | list | Mapping, output_root: str = "Outputs") -> Collection | ModelCollection:
    """Files, a pattern, a list taken as it is, or a mapping of labels."""
    return open_models(spark, path, output_root) if isinstance(path, Mapping) else Collection(spark, discovery.resolve(path), output_root)
