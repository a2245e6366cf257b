"""What the operators share: the shared scratch folder, Arrow batches as bytes, and small helpers.

Texts are handled as UTF-8 bytes wherever the rules speak of ASCII characters only: `bytes.split()`,
`bytes.strip()` and `bytes.lower()` know exactly the ASCII white space (x20, x09-x0D) and A-Z, while
their `str` counterparts follow Unicode.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space of every word and line rule here.
SPACE = b" \t\n\x0b\x0c\r"
#: Rows in an Arrow batch: bounds a Python worker's memory at this many texts.
BATCH_ROWS = 256


_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows that a Python worker gets at once, for texts can be long. One value for all operators, as frames are run after they are built."""
    if not 0 < int(spark.conf.get(_ROWS, "10000")) <= BATCH_ROWS:
        spark.conf.set(_ROWS, str(BATCH_ROWS))


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches of another number of rows, for jobs that run inside; the session's own number is put back."""
    before = spark.conf.get(_ROWS, "10000")
    spark.conf.set(_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_ROWS, before)


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where it is unset on one machine (tests) a local one is made and set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = have.get() if have.isDefined() else None
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="starloom-shared-")
        atexit.register(shutil.rmtree, at, True)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, path: str, codec: str = "zstd") -> DataFrame:
    """Writes a table and rereads it: lineage ends here and survives the loss of an executor."""
    df.write.mode("overwrite").option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *paths: str) -> None:
    """Removes written tables that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Lets Spark drop shuffle files of finished jobs now rather than at the driver's next collection."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def lean(run):
    """A batch function that returns freed memory to the system when its task ends; workers live on between tasks."""

    @functools.wraps(run)
    def call(batches):
        yield from run(batches)
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return call


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20):
    """The batch in runs of whole rows with at most so many bytes of text each (a longer single text stands alone)."""
    texts = as_bytes(batch.column(column))
    at = size = 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if i > at and size + n > most:
            yield batch.slice(at, i - at), texts[at:i]
            at, size = i, 0
        size += n
    if len(texts) > at:
        yield batch.slice(at), texts[at:]


def table(path_or_dir: str, name: str) -> str:
    return f"{path_or_dir}/{name}.parquet"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(table(sf_dir, "documents"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit integers that spreads every bit (multiply and xor-shift)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    """Path of an installed vocabulary file; resolved where it is used, as it need not be the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shards_for(df: DataFrame, shard_bytes: int, least: int = 4) -> int:
    """A power of two: one shard for so many bytes of a table, as Spark estimates its size. Where that is no estimate (over 2**50: rows not from files, joins), the texts are measured."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > 1 << 50:
        size = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return 1 << (max(least, -(-size // shard_bytes)) - 1).bit_length()


def by_shard(df: DataFrame, shards: int, run: Callable, schema: str, *keys: str) -> DataFrame:
    """Applies run(key, batches) to each group of rows with equal `keys`; the first of them is the shard, and every shard is a partition of its own."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from (out for key, group in grouped(batches, keys) for out in run(key, group))

    return df.repartitionById(shards, F.col(keys[0])).sortWithinPartitions(*keys).mapInArrow(lean(groups), schema)


def grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple[int, ...], Iterator[pa.RecordBatch]]]:
    """Runs of rows with equal keys, each as (key, its batches as they come)."""
    pieces = _pieces(batches, keys)
    held = next(pieces, None)

    def own(key: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
        nonlocal held
        while held is not None and held[0] == key:
            rows, held = held[1], None
            yield rows
            held = next(pieces, None)

    while held is not None:
        key = held[0]
        group = own(key)
        yield key, group
        for _ in group:  # what was not read
            pass


def _pieces(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple[int, ...], pa.RecordBatch]]:
    for batch in batches:
        values = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys], axis=1)
        cuts = np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)], strict=True):
            if i < j:
                yield tuple(values[i].tolist()), batch.slice(i, j - i)


def bounded_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
