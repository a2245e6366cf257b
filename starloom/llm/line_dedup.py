"""Line dedup over levelled sorted runs of line hashes.

A text's lines are split at \\n (null or empty: one empty line). A line's key is the line without the ASCII white
space `[\\x20\\x09-\\x0D]` at its ends, A-Z lower-cased; keys shorter than `least_chars` code points are never
looked at. A key found in at least `least_docs` documents loses all its lines except in the largest doc_id
that holds it.

Index. A key is a 128-bit hash. Documents come in batches, largest doc_ids first. A batch's keys are counted
(pre-aggregated before the shuffle, so a line that a third of all documents hold is a row per task), then
merge-anti-joined to the runs: keys that no run holds are fresh and enter the batch's run with the doc_id that
keeps the line; for known keys the run adds only to the count. Runs are tables bucketed and sorted by key, in the
shared folder. A batch's keys are shuffled once to meet them; runs are merged two at a time by a join of their buckets,
without a shuffle, and written bucketed again. When `fan` runs stand on a level, they are merged into one of the next: each key is
rewritten once a level. The frequent keys are a written table. While they are at most `most_broadcast` rows they are
sent to the lines; beyond that only those that make up a 100,000th of all lines each are (at most 100,000 rows), and the
others, none of which is a heavy key any more, are joined by a shuffle.

Defined cases. Rows that share a doc_id are documents of their own; if theirs is the largest, both keep the line.
A null doc_id counts as a document, keeps all its lines, and is never the keeper while another document holds
the line. Lines repeated in one document count once and stay or go together. Empty tables give empty results.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, as_bytes, bounded_partitions, discard, kept, lean, scratch, slices, small_batches

KEYS = "doc_id long, hi long, lo long"


def keys_of(text: bytes | None, least_chars: int) -> list[bytes | None]:
    """Each line's key, or None where it is too short."""
    out: list[bytes | None] = []
    for line in (text or b"").split(b"\n"):
        key = line.strip(SPACE).lower()
        out.append(key if len(key) >= least_chars and (len(key) >= 4 * least_chars or len(key.decode()) >= least_chars) else None)
    return out


def _hashed(least_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in slices(batch, "text"):
                digests, sizes = [], []
                for text in texts:
                    own = {xxhash.xxh3_128_digest(k) for k in keys_of(text, least_chars) if k is not None}
                    digests += own
                    sizes.append(len(own))
                pairs = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                docs = rows.column("doc_id").cast(pa.int64()).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
                yield pa.RecordBatch.from_arrays([docs, pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["doc_id", "hi", "lo"])

    return run


def line_keys(docs: DataFrame, least_chars: int = 20) -> DataFrame:
    """doc_id and key of each document's distinct lines."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(_hashed(least_chars)), KEYS)


class LineIndex:
    """Runs of (key, number of documents, keeper), bucketed and sorted by key, on levels."""

    def __init__(self, spark: SparkSession, buckets: int, fan: int = 2) -> None:
        self.spark, self.buckets, self.fan, self.name = spark, buckets, fan, f"line_run_{uuid.uuid4().hex[:12]}"
        self.levels: list[list[str]] = [[]]
        self.paths: dict[str, str] = {}

    def _store(self, rows: DataFrame) -> str:
        name = f"{self.name}_{len(self.paths)}"
        self.paths[name] = scratch(self.spark, "line-run")
        rows.select("hi", "lo", "n", "keeper").write.option("path", self.paths[name]).bucketBy(self.buckets, "hi", "lo").sortBy("hi", "lo").saveAsTable(name, format="parquet", compression="zstd")
        return name

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"drop table if exists {name}")
            discard(self.spark, self.paths[name])

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def merged(self, one: str, other: str) -> DataFrame:
        """The keys of two runs, each once. Runs are bucketed alike: a merge join of buckets, without a shuffle."""
        a, b = (self.spark.table(name).alias(side) for side, name in (("a", one), ("b", other)))
        both = a.hint("merge").join(b, (F.col("a.hi") == F.col("b.hi")) & (F.col("a.lo") == F.col("b.lo")), "full")
        number = F.coalesce("a.n", F.lit(0)) + F.coalesce("b.n", F.lit(0))
        return both.select(F.coalesce("a.hi", "b.hi").alias("hi"), F.coalesce("a.lo", "b.lo").alias("lo"), number.alias("n"), F.greatest("a.keeper", "b.keeper").alias("keeper"))

    def _merge(self, names: list[str]) -> str:
        """One run of several, two at a time; each merged run is written, for what is joined next must be bucketed."""
        while len(names) > 1:
            made = self._store(self.merged(*names[:2]))
            self._drop(names[:2])
            names = [made, *names[2:]]
        return names[0]

    def add(self, batch: DataFrame) -> None:
        """A batch of (doc_id, hi, lo), whose doc_ids are below those of the batches before it."""
        rows = batch.groupBy("hi", "lo").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))
        if names := self.runs():
            shape, counted = rows.schema, scratch(self.spark, "lines")
            rows = kept(rows, counted)
            fresh = rows
            for name in names:
                known = self.spark.table(name).where("keeper is not null").select("hi", "lo")
                fresh = fresh.hint("merge").join(known, ["hi", "lo"], "left_anti")
            old = rows.alias("r").join(fresh.select("hi", "lo").hint("merge"), ["hi", "lo"], "left_anti").withColumn("keeper", F.lit(None).cast(shape["keeper"].dataType))
            name = self._store(fresh.unionAll(old.select(fresh.columns)))
            discard(self.spark, counted)
        else:
            name = self._store(rows)
        self.levels[0].append(name)
        self._compact()

    def _compact(self) -> None:
        k = 0
        while k < len(self.levels):
            if len(self.levels[k]) >= self.fan:
                old, self.levels[k] = self.levels[k], []
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(self._merge(old))
            k += 1

    def frequent(self, least_docs: int) -> DataFrame:
        """The keys in at least so many documents, with that number and the doc_id that keeps their lines."""
        self.levels = [[self._merge(self.runs())]]  # small runs first
        return self.spark.table(self.levels[0][0]).where(F.col("n") >= least_docs).select("hi", "lo", "n", "keeper")

    def close(self) -> None:
        self._drop(list(self.paths))
        self.levels = [[]]


def _bounds(docs: DataFrame, batches: int) -> list[int]:
    """doc_ids that part the documents into about equal batches."""
    cuts = docs.select(F.percentile_approx(F.col("doc_id").cast("long"), [k / batches for k in range(1, batches)], 1000)).first()[0] or []
    return sorted(set(cuts))


def _lost(pairs: DataFrame, frequent: DataFrame, most_broadcast: int) -> DataFrame:
    """The rows of pairs that lose their line."""
    later = F.col("doc_id") < F.col("keeper")
    if frequent.count() <= most_broadcast:
        return pairs.join(F.broadcast(frequent.drop("n")), ["hi", "lo"]).where(later)
    heavy = F.col("n") * 100_000 >= F.lit(pairs.count())
    hot = F.broadcast(frequent.where(heavy).drop("n"))
    rest = pairs.join(hot.drop("keeper"), ["hi", "lo"], "left_anti").join(frequent.where(~heavy).drop("n").hint("merge"), ["hi", "lo"])
    return pairs.join(hot, ["hi", "lo"]).select(*pairs.columns, "keeper").unionAll(rest.select(*pairs.columns, "keeper")).where(later)


def repeated_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, batches: int = 4, buckets: int | None = None, most_broadcast: int = 500_000) -> DataFrame:
    """doc_id and the keys (array of structs) of the lines that it loses; only documents that lose any. The table is written."""
    spark = docs.sparkSession
    at, frequent_at = scratch(spark, "line-keys"), scratch(spark, "frequent-lines")
    index = LineIndex(spark, buckets or bounded_partitions(spark))
    try:
        pairs = kept(line_keys(docs, least_chars), at)
        cuts = _bounds(docs, batches)
        for k in range(len(cuts), -1, -1):
            inside = F.lit(True)
            if k < len(cuts):
                inside = F.col("doc_id") <= cuts[k]
            if k:
                inside &= F.col("doc_id") > cuts[k - 1]
            else:
                inside |= F.col("doc_id").isNull()
            index.add(pairs.where(inside))
        frequent = kept(index.frequent(least_docs), frequent_at)
        # a document's lines bound its array; rows of one doc_id are one row here
        lost = _lost(pairs, frequent, most_broadcast).groupBy("doc_id").agg(F.collect_set(F.struct("hi", "lo")).alias("lost"))
        return kept(lost, scratch(spark, "lost-lines"))
    finally:
        index.close()
        discard(spark, at, frequent_at)


def _dropper(least_chars: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lost = as_bytes(batch.column(names.index("text"))), batch.column(len(names)).to_pylist()
            out, total, gone = [], [], []
            for text, keys in zip(texts, lost, strict=True):
                lines = (text or b"").split(b"\n")
                total.append(len(lines))
                if not keys:
                    gone.append(0)
                    out.append(text)
                    continue
                bad = {np.array([k["hi"], k["lo"]], "<i8").tobytes() for k in keys}
                stay = [line for line, key in zip(lines, keys_of(text, least_chars), strict=True) if key is None or xxhash.xxh3_128_digest(key) not in bad]
                gone.append(len(lines) - len(stay))
                out.append(b"\n".join(stay))
            columns = [batch.column(i) for i in range(len(names))]
            columns[names.index("text")] = pa.array(out, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(gone, pa.int64())], [f"c{i}" for i in range(len(names) + 2)])

    return run


def drop_repeated_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, batches: int = 4, n_lines: str = "n_lines", n_dropped: str = "n_dropped", most_broadcast: int = 500_000) -> DataFrame:
    """The documents with all their columns, their text without the lines that go, and two more columns: lines before, lines dropped.

    A null text stays null; a text that loses all its lines becomes empty. Columns of docs may have any names
    (the two added ones can be renamed if they clash).
    """
    spark = docs.sparkSession
    lost = repeated_lines(docs.select("doc_id", "text"), least_chars, least_docs, batches, None, most_broadcast)
    names = docs.columns
    key, keys = "doc_id", f"lost_{uuid.uuid4().hex}"
    small_batches(spark)
    joined = docs.join(lost.select(F.col("doc_id").alias(f"{keys}_id"), F.col("lost").alias(keys)), F.col(key).cast("long") == F.col(f"{keys}_id"), "left").select(*[docs[c] for c in names], keys)
    plain = joined.toDF(*[f"c{i}" for i in range(len(names) + 1)])
    shape = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)] + [T.StructField(f"c{len(names)}", T.LongType()), T.StructField(f"c{len(names) + 1}", T.LongType())])
    return plain.mapInArrow(lean(_dropper(least_chars, names)), shape).toDF(*names, n_lines, n_dropped)

