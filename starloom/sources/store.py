"""The native layout of a simulation file: a folder of Parquet tables.

    <name>.store/
      file.parquet         status_completion (int, 0: complete)
      outputs.parquet      index, name, path, time, scale_factor, redshift, output_type
      properties.parquet   output_name, name, dtype, shape, description, units_in_si, units, quantity, is_comoving
      attributes.parquet   path, kind (group or dataset), key, value (text)
      analyses.parquet     one row per analysis, see operators.analyses
      nodes/output_name=Output1/...   row_in_file and a column per property

Outputs are partitions, so that only those asked for are read; columns and filters reach the Parquet scan.
Columns named with a slash stand for properties outside nodeData.
"""

from __future__ import annotations

import functools
import os
import re

import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OUTPUTS = "index int, name string, path string, time double, scale_factor double, redshift double, output_type string"
PROPERTIES = "output_name string, name string, dtype string, shape string, description string, units_in_si double, units string, quantity string, is_comoving int"
ATTRIBUTES = "path string, kind string, key string, value string"
ANALYSES = (
    "name string, type string, description string, x_label string, y_label string, x_log boolean, y_log boolean, target_label string, has_target boolean, "
    "x array<double>, y array<double>, y_lower array<double>, y_upper array<double>, y_covariance array<array<double>>, "
    "y_target array<double>, target_lower array<double>, target_upper array<double>, target_covariance array<array<double>>"
)
FILE = "status_completion int"


def write(path: str, nodes: DataFrame, outputs: DataFrame, status: int | None = 0, properties: DataFrame | None = None, attributes: DataFrame | None = None, analyses: DataFrame | None = None) -> None:
    """nodes: output_name, row_in_file and the properties."""
    spark = nodes.sparkSession
    shaped = lambda df, schema: spark.createDataFrame([], schema) if df is None else df.select(*[F.col(f.name).cast(f.dataType) for f in T._parse_datatype_string(schema).fields])
    spark.createDataFrame([(status,)], FILE).coalesce(1).write.parquet(f"{path}/file.parquet")
    shaped(outputs, OUTPUTS).coalesce(1).write.parquet(f"{path}/outputs.parquet")
    shaped(properties, PROPERTIES).coalesce(1).write.parquet(f"{path}/properties.parquet")
    shaped(attributes, ATTRIBUTES).coalesce(1).write.parquet(f"{path}/attributes.parquet")
    if analyses is not None:
        shaped(analyses, ANALYSES).coalesce(1).write.parquet(f"{path}/analyses.parquet")
    nodes.write.partitionBy("output_name").parquet(f"{path}/nodes")


def is_store(path: str) -> bool:
    return os.path.isdir(f"{path}/nodes") or "://" in path


def table(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/{name}.parquet")


def _roots(spark: SparkSession, paths: list[str], below: str) -> DataFrame:
    """file_ord, path, and the folder as Spark names it in _metadata.file_path."""
    rows = []
    for i, path in enumerate(paths):
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{below}")
        rows.append((i, path, re.sub("^file:/+", "file:/", at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri().toString())))
    return spark.createDataFrame(rows, "file_ord int, path string, root string")


def _place() -> Column:
    """A row's file; local ones may be written with one slash or three."""
    return F.regexp_replace("_metadata.file_path", "^file:/+", "file:/")


def _columns(spark: SparkSession, path: str) -> set[str]:
    """The columns of a file's rows; of a mounted file from one footer, without a job."""
    if "://" not in path:
        for folder, _, names in os.walk(f"{path}/nodes"):
            for name in names:
                if name.endswith(".parquet"):
                    return {"output_name", *pq.read_schema(f"{folder}/{name}").names}
    return set(spark.read.parquet(f"{path}/nodes").columns)


def nodes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The rows of all files: output_name, file_ord, row_in_file and the first file's columns. One scan, however many files: a row's file is told by its path."""
    first = spark.read.parquet(f"{paths[0]}/nodes")
    if len(paths) == 1:
        return first.withColumn("file_ord", F.lit(0))
    for path in paths[1:]:
        if missing := [c for c in first.columns if c not in _columns(spark, path)]:
            raise KeyError(f"{missing[0]!r} is missing in {path}")
    if len(set(paths)) < len(paths):  # a scan reads a path once
        parts = [spark.read.schema(first.schema).parquet(f"{p}/nodes").withColumn("file_ord", F.lit(i)) for i, p in enumerate(paths)]
        return functools.reduce(DataFrame.unionAll, parts)
    # partitions of several folders are not discovered together, so the output is told by the path too; conditions on it still choose files, not rows
    plain = T.StructType([f for f in first.schema if f.name != "output_name"])
    rows = spark.read.schema(plain).option("recursiveFileLookup", "true").parquet(*[f"{p}/nodes" for p in paths])
    part = lambda k: F.regexp_extract(_place(), "^(.*)/output_name=([^/]*)/[^/]*$", k)
    rows = rows.select(*plain.names, part(2).alias("output_name"), part(1).alias("__root"))
    return rows.join(F.broadcast(_roots(spark, paths, "nodes")).select("file_ord", F.col("root").alias("__root")), "__root").select(*first.columns, "file_ord")


def status(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file_ord, path, status_completion of all files, by one scan."""
    found = spark.read.schema(FILE).parquet(*[f"{p}/file.parquet" for p in dict.fromkeys(paths)]).select("status_completion", F.regexp_extract(_place(), "^(.*)/[^/]*$", 1).alias("root"))
    return F.broadcast(_roots(spark, paths, "file.parquet")).join(found, "root", "left").select("file_ord", "path", "status_completion")


def ingest(spark: SparkSession, source: str, path: str, output_root: str = "Outputs") -> None:
    """Turns an HDF5 file into this layout. Needs h5py where it runs."""
    from . import hdf5

    meta = hdf5.describe(source, output_root)
    rows = None
    for name in [o[1] for o in meta["outputs"]]:
        part = hdf5.scan(spark, [source], f"{output_root}/{name}/nodeData").drop("file_ord").withColumn("output_name", F.lit(name))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    if rows is None:
        raise KeyError(f"{source} has no outputs under {output_root}")
    frame = lambda key, schema: spark.createDataFrame(meta[key], schema)
    write(path, rows, frame("outputs", OUTPUTS), meta["status"], frame("properties", PROPERTIES), frame("attributes", ATTRIBUTES), frame("analyses", ANALYSES) if meta["analyses"] is not None else None)
