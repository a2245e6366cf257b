"""Projection, renaming and row selection over files read one after the other."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLACE = ["file_ord", "row_in_file"]
ROW = "global_row"


def column_of(path: str) -> str:
    """A property's column: its path without the leading nodeData."""
    return path.removeprefix("nodeData/")


def project(nodes: DataFrame, datasets: Sequence[str] | Mapping[str, str]) -> DataFrame:
    """The place columns and the datasets, by path or as label: path. A missing one is a KeyError."""
    wanted = dict(datasets) if isinstance(datasets, Mapping) else {d: d for d in datasets}
    for path in wanted.values():
        if column_of(path) not in nodes.columns:
            raise KeyError(f"no dataset {path!r}")
    return nodes.select(*PLACE, *[F.col(f"`{column_of(path)}`").alias(label, metadata=nodes.schema[column_of(path)].metadata) for label, path in wanted.items()])


def numbered(nodes: DataFrame) -> DataFrame:
    """Adds the row's number over all files. Rows of each file are counted first, so no global sort is needed."""
    sizes = nodes.groupBy("file_ord").agg(F.count("*").alias("n"))
    # as many rows as files: their running sum is cheap
    before = sizes.select("file_ord", F.coalesce(F.sum("n").over(Window.orderBy("file_ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return nodes.join(F.broadcast(before), "file_ord").withColumn(ROW, F.col("before") + F.col("row_in_file")).drop("before")


def take(nodes: DataFrame, where: Sequence[int]) -> DataFrame:
    """Rows by number, in the order given; numbers may repeat or count from the end. An empty list takes nothing.

    `position` is the place in the list. A number out of range is an IndexError.
    """
    spark = nodes.sparkSession
    rows = numbered(nodes)
    asked = [int(i) for i in where]
    if asked and (min(asked) < 0 or max(asked) >= 0):
        n = nodes.count()
        bad = [i for i in asked if not -n <= i < n]
        if bad:
            raise IndexError(f"row {bad[0]} of {n}")
        asked = [i + n if i < 0 else i for i in asked]
    wanted = spark.createDataFrame([(p, i) for p, i in enumerate(asked)], f"position long, {ROW} long")
    return rows.join(F.broadcast(wanted) if len(asked) <= 1_000_000 else wanted, ROW).orderBy("position")


#: Rows whose flags travel together, as words of 64.
FLAGS = 1 << 16


def mask(nodes: DataFrame, where: Sequence[bool]) -> DataFrame:
    """Rows where the mask, one value per row of all files, is true. A bit per row is sent, in blocks, and none for blocks without a true value."""
    flags = np.asarray(where, bool)
    n = nodes.count()
    if len(flags) != n:
        raise IndexError(f"the mask has {len(flags)} values for {n} rows")
    blocks = []
    for at in range(0, n, FLAGS):
        part = flags[at : at + FLAGS]
        if part.any():
            padded = np.zeros(-(-len(part) // 64) * 64, bool)
            padded[: len(part)] = part
            blocks.append((at // FLAGS, np.packbits(padded, bitorder="little").view("<i8").tolist()))
    bits = nodes.sparkSession.createDataFrame(blocks, "block long, words array<long>")
    row = F.col(ROW)
    rows = numbered(nodes).join(F.broadcast(bits) if n <= 1 << 28 else bits, F.floor(row / FLAGS) == F.col("block"))
    word = F.get("words", ((row % FLAGS) / 64).cast("int"))
    return rows.where(F.getbit(word, (row % 64).cast("int")) == 1).drop("block", "words")


def select_rows(nodes: DataFrame, where: Column | str | Sequence | None) -> DataFrame:
    """A condition (pushed to the scan), a mask, or row numbers."""
    if where is None:
        return nodes
    if isinstance(where, (Column, str)):
        return nodes.where(where)
    values = np.asarray(where)
    return mask(nodes, values) if values.dtype == bool else take(nodes, values.tolist())


def read(nodes: DataFrame, datasets: Sequence[str] | Mapping[str, str], where: Column | str | Sequence | None = None) -> DataFrame:
    """Select rows, then columns; without row numbers both reach the scan."""
    wanted = list(datasets.values()) if isinstance(datasets, Mapping) else list(datasets)
    chosen = select_rows(nodes, where)
    extra = [c for c in ("position",) if c in chosen.columns]
    out = project(chosen, datasets)
    if extra:
        names = out.columns
        project(nodes, wanted)
        out = chosen.select("position", *PLACE, *[F.col(f"`{column_of(p)}`").alias(label) for label, p in (datasets.items() if isinstance(datasets, Mapping) else zip(datasets, datasets, strict=True))]).orderBy("position").select("position", *names)
    return out
