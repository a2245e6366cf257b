"""Chain logs: one text file per rank, one step per line.

Columns: step, chain index, evaluation time, converged (T/F), log posterior, log likelihood, then the state, and
for particle swarms as many velocities. Blank lines, lines that begin with a quotation mark and header lines (#) carry no step.

Files are read as text by Spark, in splits; a line's place is its split's offset in the file and its order within the split,
so large logs need not be read by one task. Only a count per file and the header lines reach the driver.
"""

from __future__ import annotations

import glob
import re
from collections.abc import Sequence
from dataclasses import dataclass, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import MCMCConfig

ROWS = "chain_pos int, chain_index long, path string, row_idx long, step long, eval_time double, converged boolean, log_posterior double, log_likelihood double, state array<double>, velocity array<double>"
LEADING = 6


def discover_chain_files(log_file_root: str | Path) -> list[Path]:
    """The logs of all ranks, in order."""
    return [Path(p) for p in sorted(glob.glob(f"{glob.escape(str(Path(log_file_root)))}_[0-9][0-9][0-9][0-9].log"))]


@dataclass(frozen=True)
class Chain:
    """One chain of a set: where it stands, its index, its file and number of rows. Its rows are a filter of the set's."""

    chain_pos: int
    chain_index: int
    path: str
    n_steps: int
    rows: DataFrame


@dataclass(frozen=True)
class ChainSet(Sequence):
    """Chains in file order: `rows` as in ROWS, and the chains' own table on the driver."""

    config: MCMCConfig
    rows: DataFrame
    table: tuple[tuple[int, int, str, int], ...]  # chain_pos, chain_index, path, rows

    def __len__(self) -> int:
        return len(self.table)

    def __getitem__(self, key: int | slice) -> Chain | ChainSet:
        if isinstance(key, slice):
            return self._only(self.table[key])
        pos, index, path, n = self.table[key]
        return Chain(pos, index, path, n, self.rows.where(F.col("chain_pos") == pos).orderBy("row_idx"))

    def _only(self, table: tuple) -> ChainSet:
        return replace(self, rows=self.rows.where(F.col("chain_pos").isin([t[0] for t in table])), table=tuple(table))

    @property
    def n_params(self) -> int:
        return len(self.config.parameters)

    def without(self, drop_chains: Sequence[int] = ()) -> ChainSet:
        """Without the chains of these indices."""
        gone = {int(i) for i in drop_chains}
        return self._only([t for t in self.table if t[1] not in gone]) if gone else self

    def post_burn(self, burn: int) -> ChainSet:
        """Without the first rows of each chain (rows, not step numbers)."""
        if burn < 0:
            raise ValueError(f"burn must not be negative; got {burn}")
        rows = self.rows.where(F.col("row_idx") >= burn).withColumn("row_idx", F.col("row_idx") - burn)
        return replace(self, rows=rows, table=tuple((p, i, f, max(0, n - burn)) for p, i, f, n in self.table))

    def concatenated(self, burn: int = 0, drop_chains: Sequence[int] = ()) -> DataFrame:
        """The rows of all chains but those dropped, one after the other."""
        return self.without(drop_chains).post_burn(burn).rows.orderBy("chain_pos", "row_idx")

    @property
    def shortest(self) -> int:
        return min((t[3] for t in self.table), default=0)


def _header_names(lines: list[str]) -> list[str]:
    found = []
    for line in lines:
        m = re.match(r"#\s*(\d+)\s*=\s*Parameter\s+`(.*?)`", line)
        if m and int(m[1]) > LEADING:
            found.append((int(m[1]), m[2]))
    return [n for _, n in sorted(found)]


def parse(lines: DataFrame, columns: int, n_params: int) -> DataFrame:
    """Lines (path, place..., value) to chain columns; malformed lines raise where they are read."""
    t = F.col("tokens")
    number = lambda i: F.element_at(t, i).cast("double")
    word = F.upper(F.regexp_replace(F.element_at(t, 4), r"^\.+|\.+$", ""))
    flag = F.when(word.isin("T", "TRUE"), True).when(word.isin("F", "FALSE"), False).otherwise(F.raise_error(F.concat(F.lit("not a logical value: "), F.element_at(t, 4))).cast("boolean"))
    whole = F.when(F.size(t) >= LEADING + columns, t).otherwise(F.raise_error(F.concat(F.lit(f"fewer than {LEADING + columns} columns in "), F.col("path"))).cast("array<string>"))
    values = lambda first: F.transform(F.slice(t, first, n_params), lambda x: x.cast("double"))
    step = lines.withColumn("tokens", F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")).withColumn("tokens", whole)
    return step.select(
        "path", "block", "line", number(1).cast("long").alias("step"), number(2).cast("long").alias("chain_index"), number(3).alias("eval_time"), flag.alias("converged"), number(5).alias("log_posterior"), number(6).alias("log_likelihood"),
        values(LEADING + 1).alias("state"), (values(LEADING + 1 + n_params) if columns > n_params else F.lit(None).cast("array<double>")).alias("velocity"),
    )


def read_chains(spark: SparkSession, config: MCMCConfig, cache: bool = True) -> ChainSet:
    """All logs of a run. A file's chain index is that of its second column, or of its name if it has no rows."""
    files = discover_chain_files(config.log_file_root)
    if not files:
        raise FileNotFoundError(f"no chain logs at {config.log_file_root}_NNNN.log")
    paths = [str(f) for f in files]
    order = {f.resolve().as_uri(): i for i, f in enumerate(files)}
    raw = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_block_start").alias("block"))
    raw = raw.withColumn("line", F.monotonically_increasing_id()).withColumn("path", F.regexp_replace("uri", "^file:/+", "/"))
    bare = F.trim(F.regexp_replace("value", r"\s+", " "))
    headers: dict[str, list[str]] = {}
    for r in raw.where(bare.startswith("#") & bare.contains("Parameter")).select("path", "value", "block", "line").distinct().orderBy("path", "block", "line").collect():
        headers.setdefault(r["path"], []).append(r["value"].strip())
    for path, lines in headers.items():
        names = _header_names(lines)
        if names and names[: len(config.parameters)] != list(config.parameter_names):
            raise ValueError(f"{path} names the parameters {names}, the configuration {list(config.parameter_names)}")
    steps = parse(raw.where((bare != "") & ~bare.startswith("#") & ~bare.startswith('"')), config.state_columns, len(config.parameters))
    position = F.create_map(*[x for uri, i in order.items() for x in (F.lit(re.sub("^file:/+", "/", uri)), F.lit(i))])
    placed = steps.withColumn("chain_pos", F.element_at(position, F.col("path")))
    # numbered within each split, and the splits of a file by their counts
    sizes = steps.groupBy("path", "block").agg(F.count("*").alias("n"))
    before = sizes.select("path", "block", F.expr("coalesce(sum(n) over (partition by path order by block rows between unbounded preceding and 1 preceding), 0)").alias("before"))
    inside = F.row_number().over(Window.partitionBy("path", "block").orderBy("line"))
    placed = placed.join(before, ["path", "block"]).withColumn("row_idx", F.col("before") + inside.cast("long") - 1)
    rows = placed.select("chain_pos", "chain_index", "path", "row_idx", "step", "eval_time", "converged", "log_posterior", "log_likelihood", "state", "velocity")
    if cache:
        rows = rows.cache()
    counts = {r[0]: r for r in rows.groupBy("chain_pos").agg(F.count("*").alias("n"), F.min("chain_index"), F.max("chain_index")).collect()}
    table = []
    for i, f in enumerate(files):
        if i not in counts:
            table.append((i, int(re.search(r"_(\d{4})\.log$", f.name)[1]), str(f), 0))
            continue
        _, n, low, high = counts[i]
        if low != high:
            raise ValueError(f"{f} holds rows of several chains ({low} and {high})")
        table.append((i, low, str(f), n))
    return ChainSet(config, rows, tuple(table))


def from_rows(config: MCMCConfig, rows: DataFrame) -> ChainSet:
    """A set from rows with chain_pos, chain_index, row_idx, step, log_posterior, log_likelihood and state."""
    table = tuple((r[0], r[1], "", r[2]) for r in rows.groupBy("chain_pos", "chain_index").agg(F.count("*")).orderBy("chain_pos").collect())
    return ChainSet(config, rows, table)
