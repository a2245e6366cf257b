"""Tracing objects over outputs: a left join of the asked ids with each output's rows, one array per property and id."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import NAN
from ..functions.text import some_ids
from .reading import column_of

RESERVED = ("time", "expansion_factor", "redshift", "present", "output_names", "ids")
POLICIES = ("error", "warn", "first")
#: Kinds of outputs whose objects are not those of a snapshot.
UNTRACED = ("node", "lightcone")


def fill_value(kind: T.DataType, int_sentinel: int) -> Column:
    """What stands for an absent object: NaN, the sentinel, or false; arrays of these are handled by their caller."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.lit(NAN).cast(kind)
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)):
        return F.lit(int_sentinel).cast(kind)
    if isinstance(kind, T.BooleanType):
        return F.lit(False)
    raise NotImplementedError(f"values of type {kind.simpleString()} cannot be traced")


def _filled(value: Column, kind: T.DataType, width: int | None, int_sentinel: int) -> Column:
    if isinstance(kind, T.ArrayType):
        return F.coalesce(value, F.array_repeat(_filled(F.lit(None).cast(kind.elementType), kind.elementType, None, int_sentinel), F.lit(width or 0)))
    return F.coalesce(value, fill_value(kind, int_sentinel))


def first_matches(nodes: DataFrame, id_column: str) -> DataFrame:
    """For each output, file and id the lowest row; `copies` says how many there were."""
    per = Window.partitionBy("output_name", "file_ord", id_column)
    return nodes.withColumn("copies", F.count("*").over(per)).withColumn("rank", F.row_number().over(per.orderBy("row_in_file"))).where("rank = 1").drop("rank")


def trace(nodes: DataFrame, outputs: DataFrame, requests: DataFrame, properties: Mapping[str, str], id_column: str, int_sentinel: int = -1, widths: Mapping[str, int] | None = None) -> DataFrame:
    """requests (position, id) x outputs (slot, output_name, time, scale_factor) with the matching rows of nodes.

    One row per request and output: position, id, slot, output_name, present, time, expansion_factor and the
    properties, filled where the object is absent. Of matches in several files the first file's counts. The
    outputs are few and broadcast; the ids are joined as Spark sees fit.
    """
    kinds = {label: nodes.schema[column_of(p)].dataType for label, p in properties.items()}
    wanted = nodes.join(F.broadcast(outputs.select("output_name").distinct()), "output_name", "left_semi")
    wanted = wanted.select("output_name", "file_ord", "row_in_file", F.col(f"`{id_column}`").cast("long").alias("id"), *[F.col(f"`{column_of(p)}`").alias(f"p_{label}") for label, p in properties.items()])
    asked = wanted.join(requests.select("id").distinct(), "id", "left_semi")
    first = Window.partitionBy("output_name", "id").orderBy("file_ord", "row_in_file")
    hits = asked.withColumn("rank", F.row_number().over(first)).where("rank = 1").drop("rank", "file_ord", "row_in_file").withColumn("hit", F.lit(True))
    slots = requests.crossJoin(F.broadcast(outputs.select("slot", "output_name", "time", "scale_factor")))
    joined = slots.join(hits, ["output_name", "id"], "left")
    present = F.coalesce("hit", F.lit(False))
    return joined.select(
        "position", "id", "slot", "output_name", present.alias("present"),
        F.when(present, F.coalesce("time", F.lit(NAN))).otherwise(NAN).alias("time"), F.when(present, F.coalesce("scale_factor", F.lit(NAN))).otherwise(NAN).alias("expansion_factor"),
        *[_filled(F.col(f"p_{label}"), kinds[label], (widths or {}).get(label), int_sentinel).alias(label) for label in properties],
    )


def never_found(nodes: DataFrame, requests: DataFrame, id_column: str) -> DataFrame:
    """The asked ids that no row has."""
    return requests.select("id").distinct().join(nodes.select(F.col(f"`{id_column}`").cast("long").alias("id")), "id", "left_anti")


def _named(ids: DataFrame, most: int = 20) -> str:
    """The smallest ids and the number of the others; no more than these reach the driver."""
    first = [r[0] for r in ids.orderBy("id").limit(most + 1).collect()]
    return some_ids(first, most, ids.count() if len(first) > most else None)


def pivoted(traced: DataFrame, labels: Sequence[str]) -> DataFrame:
    """One row per request, an array over the outputs for each of the labels, time, expansion_factor, redshift and present."""
    fields = ["present", "time", "expansion_factor", *labels]
    rows = traced.groupBy("position", "id").agg(F.array_sort(F.collect_list(F.struct("slot", *fields))).alias("s"))
    redshift = F.transform("s.expansion_factor", lambda a: F.when(F.isnan(a), F.lit(NAN)).when(a == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.lit(1.0), a) - 1))
    return rows.select("position", "id", *[F.col(f"s.{f}").alias(f) for f in fields], redshift.alias("redshift"))


def trace_galaxy_history(collection, ids: Sequence[int], properties: Sequence[str] | Mapping[str, str], outputs: Sequence[int | str] | None = None, *, id_dataset: str = "nodeData/nodeUniqueIDBranchTip", on_duplicate_file_match: str = "error", int_sentinel: int = -1) -> DataFrame:
    """The history of each id, in the order asked and with repeats: see pivoted(). output names are in the frame's `present` metadata.

    Problems are found by small aggregates before the result is built: unknown outputs, ids or properties are
    KeyErrors; an id in two files is an error, a warning or ignored; several rows of one file, and ids found
    nowhere, are warned of.
    """
    if on_duplicate_file_match not in POLICIES:
        raise ValueError(f"on_duplicate_file_match must be one of {POLICIES}; got {on_duplicate_file_match!r}")
    wanted = dict(properties) if isinstance(properties, Mapping) else {p: p for p in properties}
    if clash := set(wanted) & set(RESERVED):
        raise ValueError(f"labels {sorted(clash)} are reserved")
    spark = collection.spark
    index = collection.outputs
    if outputs is None:
        chosen = list(index)
    else:
        from ..sources.discovery import output_name

        chosen = [index[output_name(o)] for o in outputs]
        if not chosen:
            raise ValueError("no outputs are chosen")
    if wrong := [m.name for m in chosen if m.output_type in UNTRACED]:
        raise ValueError(f"outputs {', '.join(wrong)} are not snapshots and cannot be traced")
    nodes = collection.nodes
    id_column = column_of(id_dataset)
    for name in (id_column, *map(column_of, wanted.values())):
        if name not in nodes.columns:
            raise KeyError(f"no dataset {name!r}")
    kinds = {label: nodes.schema[column_of(p)].dataType for label, p in wanted.items()}
    for kind in kinds.values():
        base = kind
        while isinstance(base, T.ArrayType):
            base = base.elementType
        fill_value(base, int_sentinel)
    names = list(dict.fromkeys(m.name for m in chosen))
    inside = nodes.where(F.col("output_name").isin(names))
    requests = spark.createDataFrame([(i, int(x)) for i, x in enumerate(ids)], "position long, id long")
    arrays = [label for label, kind in kinds.items() if isinstance(kind, T.ArrayType)]
    widths: dict[str, int] = {}
    if arrays:
        sizes = inside.agg(*[f(F.size(f"`{column_of(wanted[a])}`")).alias(f"{k}_{a}") for a in arrays for k, f in (("low", F.min), ("high", F.max))]).first()
        for a in arrays:
            if sizes[f"low_{a}"] != sizes[f"high_{a}"]:
                raise ValueError(f"{a!r} has different widths in the chosen outputs")
            widths[a] = sizes[f"high_{a}"] or 0
    asked = inside.select("output_name", "file_ord", F.col(f"`{id_column}`").cast("long").alias("id")).join(requests.select("id").distinct(), "id", "left_semi")
    per = asked.groupBy("output_name", "id").agg(F.countDistinct("file_ord").alias("files"), F.count("*").alias("n"))
    state = per.agg(F.coalesce(F.max("files"), F.lit(0)), F.coalesce(F.max(F.col("n") - F.col("files")), F.lit(0))).first()
    if state[0] > 1 and on_duplicate_file_match != "first":
        message = f"ids found in several files: {_named(per.where('files > 1').select('id').distinct())}"
        if on_duplicate_file_match == "error":
            raise ValueError(message)
        warnings.warn(f"{message}; the first file's rows are used", UserWarning, stacklevel=2)
    if state[1] > 0:
        warnings.warn("some ids stand several times in one file; the lowest row is used", UserWarning, stacklevel=2)
    if lost := _named(requests.select("id").distinct().join(asked.select("id").distinct(), "id", "left_anti")):
        warnings.warn(f"ids found in no output: {lost}", UserWarning, stacklevel=2)
    slots = spark.createDataFrame([(i, m.name, m.time, m.scale_factor) for i, m in enumerate(chosen)], "slot int, output_name string, time double, scale_factor double")
    out = pivoted(trace(inside, slots, requests, wanted, id_column, int_sentinel, widths), list(wanted))
    return out.withMetadata("present", {"output_names": [m.name for m in chosen]})
