"""HDF5 files as a Python data source: one input partition per file and row range.

h5py is imported where it is used and nowhere else, and everything else works without it. Tests run this module with a
stand-in for h5py. Files are opened by Python, not by Spark: their names may hold
colons. `columns` names the datasets to open, as Python sources have no column pruning of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.units import units_of

#: Number kinds and the Spark types that hold them; unsigned ones take the next wider type.
TYPES = {"f2": "float", "f4": "float", "f8": "double", "i1": "byte", "i2": "short", "i4": "int", "i8": "long", "u1": "short", "u2": "int", "u4": "long", "u8": "decimal(20,0)", "b1": "boolean"}


def _h5py():
    try:
        import h5py
    except ImportError as e:
        raise ImportError("reading HDF5 needs h5py; files in the native layout do not") from e
    return h5py


def _text(value: object) -> str:
    return value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)


def spark_type(dataset) -> str:
    """The Spark type of a dataset: one array level for each axis after the first, or for ragged values."""
    h5py = _h5py()
    ragged = h5py.check_vlen_dtype(dataset.dtype)
    levels = dataset.ndim - 1
    kind = dataset.dtype
    while ragged is not None and not isinstance(ragged, type):
        levels, kind = levels + 1, ragged
        ragged = h5py.check_vlen_dtype(kind)
    base = TYPES.get(f"{kind.kind}{kind.itemsize}", "string")
    return "array<" * levels + base + ">" * levels


def describe(path: str, output_root: str = "Outputs") -> dict:
    """What the tables of the native layout say of a file, from its attributes."""
    h5py = _h5py()
    number = lambda x: None if x is None else float(x)
    with h5py.File(path, "r") as f:
        if output_root not in f:
            raise KeyError(f"{path} has no group {output_root!r}")
        outputs, properties, attributes = [], [], []
        trailing = lambda n: int(n[6:]) if n[6:].isdigit() else 0
        for i, name in enumerate(sorted((n for n in f[output_root] if n.startswith("Output")), key=trailing), 1):
            group = f[output_root][name]
            a = number(group.attrs.get("outputExpansionFactor"))
            kind = group.attrs.get("outputType")
            outputs.append((i, name, f"/{output_root}/{name}", number(group.attrs.get("outputTime")), a, 1 / a - 1 if a and a > 0 else None, None if kind is None else _text(kind)))
            for key in sorted(group.get("nodeData", {})):
                d = group["nodeData"][key]
                if hasattr(d, "shape"):
                    raw = d.attrs.get("unitsInSI", d.attrs.get("units"))
                    names = getattr(getattr(raw, "dtype", None), "names", None)
                    u = units_of({k: raw[k].item() for k in names} if names else raw)
                    properties.append((name, key, str(d.dtype), str(d.shape), _text(d.attrs.get("comment", "")), u and u.in_si, u and u.description, u and u.quantity, u and u.is_comoving))

        def walk(name: str, node: object) -> None:
            for key, value in node.attrs.items():
                attributes.append((name, "dataset" if hasattr(node, "shape") else "group", key, _text(value)))

        f.visititems(walk)
        status = f.attrs.get("statusCompletion")
        found = _analyses(f["analyses"]) if "analyses" in f else None
    return {"outputs": outputs, "properties": properties, "attributes": attributes, "status": None if status is None else int(status), "analyses": found}


def _analyses(group, prefix: str = "") -> list[tuple]:
    """One-dimensional analyses below a group; a hit is not searched further."""
    out: list[tuple] = []
    for key in group:
        node = group.get(key)
        if node is None or hasattr(node, "shape"):
            continue
        name = f"{prefix}{key}"
        text = lambda k, node=node: _text(node.attrs.get(k, ""))
        if text("type") != "function1D":
            out += _analyses(node, f"{name}/")
            continue

        def values(k: str, node=node):
            if k not in node.attrs:
                return None
            data = node.get(_text(node.attrs[k]))
            if data is not None and not hasattr(data, "shape"):
                raise TypeError(f"{k} of {name} names a group")
            return None if data is None else data[()].tolist()

        flag = lambda k, node=node: int(node.attrs.get(k, 0)) == 1
        out.append((name, "function1D", text("description"), text("xAxisLabel"), text("yAxisLabel"), flag("xAxisIsLog"), flag("yAxisIsLog"), text("targetLabel"), "yDatasetTarget" in node.attrs, *(values(k) for k in ("xDataset", "yDataset", "yErrorLower", "yErrorUpper", "yCovariance", "yDatasetTarget", "yErrorLowerTarget", "yErrorUpperTarget", "yCovarianceTarget"))))
    return out


class _Part(InputPartition):
    def __init__(self, file_ord: int, path: str, start: int, stop: int) -> None:
        self.file_ord, self.path, self.start, self.stop = file_ord, path, start, stop


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType) -> None:
        self.options, self.names = options, [n for n in schema.names if n not in ("file_ord", "row_in_file")]

    def partitions(self) -> list[_Part]:
        h5py = _h5py()
        out = []
        step = int(self.options.get("rows", 1_000_000))
        for i, path in enumerate(self.options["files"].split("\n")):
            with h5py.File(path, "r") as f:
                n = len(f[self.options["group"]][self.names[0]]) if self.names else 0
            out += [_Part(i, path, a, min(n, a + step)) for a in range(0, n, step)]
        return out

    def read(self, part: _Part) -> Iterator[tuple]:
        with _h5py().File(part.path, "r") as f:
            group = f[self.options["group"]]
            for name in self.names:
                if name not in group:
                    raise KeyError(f"{name!r} is missing in {part.path}")
            columns = [group[n][part.start : part.stop] for n in self.names]
            for k in range(part.stop - part.start):
                yield (part.file_ord, part.start + k, *(c[k].tolist() for c in columns))


class Hdf5Source(DataSource):
    @classmethod
    def name(cls) -> str:
        return "simulation_hdf5"

    def schema(self) -> str:
        path = self.options["files"].split("\n")[0]
        with _h5py().File(path, "r") as f:
            group = f[self.options["group"]]
            names = self.options["columns"].split("\n") if self.options.get("columns") else sorted(n for n in group if hasattr(group[n], "shape"))
            kinds = [(n, spark_type(group[n])) for n in names]
        return ", ".join(["file_ord int", "row_in_file long", *(f"`{n}` {k}" for n, k in kinds)])  # as text: this runs where there is no session

    def reader(self, schema: T.StructType) -> _Reader:
        return _Reader(dict(self.options), schema)


def scan(spark: SparkSession, files: list[str], group: str, columns: list[str] | None = None) -> DataFrame:
    """file_ord, row_in_file and the datasets of a group, all files one after the other."""
    spark.dataSource.register(Hdf5Source)
    reader = spark.read.format("simulation_hdf5").option("files", "\n".join(files)).option("group", group)
    return (reader.option("columns", "\n".join(columns)) if columns else reader).load()
