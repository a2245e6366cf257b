"""Token ids as static range asymmetric numeral codes: shared frequency tables, interleaved blocks, checkpoints.

Files. A data set is a folder with two Parquet tables, so that any store Spark reads can hold it:
`tables` (id, freq: the frequencies of all ids, which sum to 2**bits) and `blocks`, one row per block:
part, block (their order is the documents' order), first_start (ids before the block), doc_ids and lengths
(little-endian int64 and uint32 arrays: the block's documents), n_ids, lanes, every (steps between
checkpoints), for each checkpoint states, words and crcs (the lanes' states and the word offset from which decoding
can begin, and the checksum of the ids up to the next one, as little-endian uint32), payload (32-bit words) and
table_crc (of the table that encoded it).

Code. Id i of a block goes to lane i % lanes, step i // lanes; each lane is a 64-bit state over one shared
word stream, so a step codes all lanes by a few array operations. A block needs nothing but the table, and
each checkpoint starts an independent run of steps. Blocks hold whole documents and close at `block_ids` ids
(a longer document is one block), so a worker holds a block at a time.

Defined cases. Null and empty texts: only the end id. Rows that share a doc_id are documents of their own,
ordered by text (null first); a null doc_id
comes first and stays null. An empty table gives no blocks and no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_ROWS, batches_of, bounded_partitions, discard, kept, lean, release, scratch, slices
from .tokens import worker_tokenizer

LOW = 31  # states stay in [2**31, 2**63)
NO_ID = -(1 << 63)  # stands for a null doc_id
RAW = "kind int, part int, block int, doc_ids binary, lengths binary, ids binary, width int"
BLOCKS = "part int, block int, doc_ids binary, lengths binary, n_ids long, lanes int, every int, states array<binary>, words array<long>, payload binary, crcs array<long>, table_crc long"


class Table:
    """Frequencies that sum to 2**bits; every id that occurs has one at least."""

    def __init__(self, freq: np.ndarray) -> None:
        self.freq = freq.astype(np.uint64)
        self.bits = int(freq.sum()).bit_length() - 1
        self.start = np.cumsum(self.freq) - self.freq
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())

    @staticmethod
    def scaled(counts: np.ndarray, bits: int = 20) -> np.ndarray:
        """Counts as frequencies: their share of what is left after one for each id that occurs; the rest goes to the most frequent id."""
        seen = counts > 0
        if not seen.any():
            return np.zeros(0, np.int64)
        room = (1 << bits) - int(seen.sum())
        if room < 0:
            raise ValueError(f"{int(seen.sum())} ids do not fit {bits} bits")
        total = int(counts.sum())
        freq = np.array([int(c) * room // total for c in counts], np.int64) + seen
        freq[int(counts.argmax())] += (1 << bits) - int(freq.sum())
        return freq

    def slots(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))


def encode(ids: np.ndarray, table: Table, lanes: int = 2048, every: int = 256) -> tuple[bytes, bytes, bytes]:
    """Payload, checkpoint states, checkpoint word offsets. Steps are coded last to first, so decoding runs forwards."""
    steps = -(-len(ids) // lanes)
    pad = np.full(steps * lanes, ids[-1] if len(ids) else 0, np.int64)
    pad[: len(ids)] = ids
    grid = pad.reshape(steps, lanes)
    bits, low = np.uint64(table.bits), np.uint64(32)
    freq, start = table.freq, table.start
    shift = np.uint64(LOW - table.bits + 32)
    x = np.full(lanes, 1 << LOW, np.uint64)
    words: list[np.ndarray] = []
    n, states, at = 0, [], []
    for step in range(steps - 1, -1, -1):
        s = grid[step]
        f = freq[s]
        out = x >= f << shift
        w = x[out]
        words.append(w.astype(np.uint32))
        n += len(w)
        x[out] = w >> low
        q = x // f
        x = (q << bits) + (x - q * f) + start[s]
        if step % every == 0:
            states.append(x.copy())
            at.append(n)
    payload = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    offsets = n - np.array(at[::-1], np.int64)
    return payload.astype("<u4").tobytes(), b"".join(s.astype("<u8").tobytes() for s in states[::-1]), offsets.astype("<i8").tobytes()


def decode(payload: bytes, states: bytes, offsets: bytes, n: int, lanes: int, every: int, table: Table, slots: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of checkpoints first to last (all by default); any run of checkpoints can be decoded by itself."""
    steps = -(-n // lanes)
    word, at = np.frombuffer(payload, "<u4"), np.frombuffer(offsets, "<i8")
    saved = np.frombuffer(states, "<u8").reshape(-1, lanes) if lanes and len(states) else np.zeros((0, lanes), np.uint64)
    last = len(at) if last is None else last
    if first >= last:
        return np.zeros(0, np.uint32)
    x, k = saved[first].copy(), int(at[first])
    bits, mask, floor, low = np.uint64(table.bits), np.uint64((1 << table.bits) - 1), np.uint64(1 << LOW), np.uint64(32)
    begin, stop = first * every, min(steps, last * every)
    out = np.empty((stop - begin, lanes), np.uint32)
    freq, start = table.freq, table.start
    for step in range(stop - begin):
        slot = x & mask
        s = slots[slot]
        out[step] = s
        x = freq[s] * (x >> bits) + slot - start[s]
        need = np.flatnonzero(x < floor)
        x[need] = (x[need] << low) | word[k : k + len(need)]
        k += len(need)
    return out.reshape(-1)[: n - begin * lanes]


def _tokenised(tokenizer: str, end: int, block_ids: int):
    """Rows in document order to blocks of whole documents; ids as uint32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, block = worker_tokenizer(tokenizer, end), TaskContext.get().partitionId(), 0
        docs: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held = 0
        total = np.zeros(0, np.int64)

        def row(kind: int, *values: object) -> pa.RecordBatch:
            types = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((kind, part, *values), types, strict=True)], [f.split()[0] for f in RAW.split(", ")])

        def close() -> pa.RecordBatch:
            nonlocal docs, sizes, ids, held, block, total
            flat = np.concatenate(ids)
            n = np.bincount(flat, minlength=len(total))
            n[: len(total)] += total
            total = n
            width = 2 if len(total) <= 1 << 16 else 4
            out = row(0, block, np.concatenate(docs).astype("<i8").tobytes(), np.concatenate(sizes).astype("<u4").tobytes(), flat.astype(f"<u{width}").tobytes(), width)
            docs, sizes, ids, held, block = [], [], [], 0, block + 1
            return out

        for batch in batches:
            for rows, texts in slices(batch, "text", 1 << 20):
                got, n = coder.encode(texts)
                docs.append(rows.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False))
                sizes.append(n)
                ids.append(got)
                held += len(got)
                if held >= block_ids:
                    yield close()
        if docs:
            yield close()
        yield row(1, 0, b"", b"", total.astype("<i8").tobytes(), 8)

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of counts to one row per id and task."""
    total = np.zeros(0, np.int64)
    for batch in batches:
        for b in batch.column("ids"):
            n = np.frombuffer(b.as_buffer(), "<i8").copy()
            if len(n) < len(total):
                n, total = total, n
            n[: len(total)] += total
            total = n
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])


def _encoded(freq: np.ndarray, lanes: int, every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(freq)
        for batch in batches:
            for r in range(batch.num_rows):
                ids = np.frombuffer(batch.column("ids")[r].as_buffer(), f"<u{batch.column('width')[r].as_py()}").astype("<u4")
                payload, states, words = encode(ids, table, lanes, every)
                saved = [states[i : i + 8 * lanes] for i in range(0, len(states), 8 * lanes)]
                crcs = [zlib.crc32(ids[i : i + lanes * every].tobytes()) for i in range(0, len(ids), lanes * every)]
                new = [len(ids), lanes, every, saved, np.frombuffer(words, "<i8").tolist(), payload, crcs, table.crc]
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()), pa.int64())
                row = batch.slice(r, 1)
                yield pa.RecordBatch.from_arrays([*(row.column(c) for c in ("part", "block", "doc_ids", "lengths")), *(pa.array([v], t) for v, t in zip(new, kinds, strict=True))], [f.split()[0] for f in BLOCKS.split(", ")])

    return run


def _ranged(rows: DataFrame, partitions: int) -> DataFrame:
    """Ranges of doc_id, one per partition, null ids with the first. The bounds come from the ids alone, so texts are read once."""
    cuts = rows.select(F.percentile_approx("doc_id", [k / partitions for k in range(1, partitions)], 100 * partitions)).first()[0] if partitions > 1 else None
    return rows.repartitionById(partitions, F.when(F.col("doc_id").isNull(), 0).otherwise(step_tree(F.col("doc_id"), sorted(set(cuts or [])))).cast("int"))


def step_tree(value: Column, edges: list[int]) -> Column:
    """Index of the first edge that is >= value, as a balanced tree of comparisons."""
    if not edges:
        return F.lit(0)

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value <= F.lit(edges[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(edges))


def write_ids(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end: int = 2, block_ids: int = 1 << 20, lanes: int = 2048, every: int = 256, partitions: int | None = None) -> None:
    """Encodes every text, appends the end id, and writes the ids in ascending doc_id order in the format above.

    Texts are tokenised once: ranges of doc_id are sorted, their ids kept as plain blocks in the shared folder
    and counted there, then each block is coded by itself with the table of all counts. One count per
    vocabulary id reaches the driver.
    """
    spark = docs.sparkSession
    raw_path = scratch(spark, "ids")
    rows = _ranged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), partitions or bounded_partitions(spark)).sortWithinPartitions("doc_id", "text")
    with batches_of(spark, 4 * BATCH_ROWS):  # more chunks repeat within a batch
        rows.mapInArrow(lean(_tokenised(tokenizer, end, block_ids)), RAW).write.option("compression", "snappy").option("parquet.block.size", 32 << 20).parquet(raw_path)
    raw = spark.read.schema(RAW).parquet(raw_path)
    del rows
    release(spark)
    with batches_of(spark, 1):  # a row is a block
        counts = raw.where("kind = 1").select("ids").mapInArrow(lean(_counted), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
        dense = np.zeros(int(counts["id"].max()) + 1 if len(counts) else 0, np.int64)
        dense[counts["id"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
        freq = Table.scaled(dense)
        spark.createDataFrame([(int(i), int(freq[i])) for i in np.flatnonzero(freq)], "id long, freq long").coalesce(1).write.parquet(f"{path}/tables")
        raw.where("kind = 0").mapInArrow(lean(_encoded(freq, lanes, every)), BLOCKS).write.option("compression", "uncompressed").option("parquet.block.size", 16 << 20).parquet(f"{path}/blocks")
    discard(spark, raw_path)


def read_table(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/tables").toPandas()
    freq = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 0, np.int64)
    freq[rows["id"].to_numpy(np.int64)] = rows["freq"].to_numpy(np.int64)
    return freq


def crc_power(n: int) -> int:
    """x ** (8 n) modulo the polynomial of crc32: what n more bytes do to a checksum."""
    out, square = 1 << 31, 1 << 23  # x ** 0 and x ** 8, highest power first
    while n:
        if n & 1:
            out = crc_product(out, square)
        square = crc_product(square, square)
        n >>= 1
    return out


def crc_product(a: int, b: int) -> int:
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def crc_joined(parts: list[tuple[int, int]]) -> int:
    """crc32 of joined pieces from each one's (crc32, bytes)."""
    out = 0
    for crc, n in parts:
        out = crc_product(out, crc_power(n)) ^ crc
    return out


def runs_of(blocks: DataFrame) -> DataFrame:
    """One row per checkpoint: the words and the state from which its steps are decoded, by themselves, and the block's documents."""
    rows = blocks.select("*", F.posexplode("words").alias("run", "at"))
    stop = F.coalesce(F.get("words", F.col("run") + 1), F.expr("octet_length(payload) div 4"))
    cut = F.substr("payload", (4 * F.col("at") + 1).cast("int"), (4 * (stop - F.col("at"))).cast("int"))
    steps = F.col("lanes") * F.col("every").cast("long")
    return rows.select("part", "block", "run", "lanes", "every", (F.col("run") * steps).alias("first"), F.least(F.col("n_ids") - F.col("run") * steps, steps).alias("n_ids"), F.get("states", "run").alias("state"), cut.alias("payload"), F.get("crcs", "run").alias("crc"), "table_crc", "doc_ids", "lengths")


def run_ids(row: dict, table: Table, slots: np.ndarray) -> np.ndarray:
    """The ids of a run, held against its checksum."""
    where = f"run {row['run']} of block {row['part']}.{row['block']}"
    if row["table_crc"] != table.crc:
        raise ValueError(f"{where} was coded with another table")
    ids = decode(row["payload"], row["state"], bytes(8), row["n_ids"], row["lanes"], row["every"], table, slots).astype("<u4")
    if zlib.crc32(ids.tobytes()) != row["crc"]:
        raise ValueError(f"{where} is damaged")
    return ids


DECODED = "part int, block int, number int, run int, whole boolean, doc_id long, start long, n long, crc long"


def _decoder(freq: np.ndarray, with_ids: bool):
    names = [f.split()[0] for f in DECODED.split(", ")] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(freq)
        slots = table.slots()
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                ids = run_ids(row, table, slots)
                ends = np.cumsum(np.frombuffer(row["lengths"], "<u4").astype(np.int64))
                begin, stop = row["first"], row["first"] + row["n_ids"]
                i, j = int(np.searchsorted(ends, begin, "right")), int(np.searchsorted(ends, stop, "left")) + 1
                before = np.concatenate([[0], ends])[i:j]  # where these documents begin
                low, high = np.maximum(before, begin) - begin, np.minimum(ends[i:j], stop) - begin
                view = memoryview(ids.tobytes())
                crc = [zlib.crc32(view[a:b]) for a, b in zip((4 * low).tolist(), (4 * high).tolist(), strict=True)]
                n, docs = len(low), np.frombuffer(row["doc_ids"], "<i8")[i:j]
                same = lambda x: pa.array(np.full(n, x, np.int32))
                columns = [same(row["part"]), same(row["block"]), pa.array(np.arange(i, j, dtype=np.int32)), same(row["run"]), pa.array(high - low == ends[i:j] - before), pa.array(docs, mask=docs == NO_ID), pa.array(before), pa.array(high - low), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(low, high[-1:]), pa.int32()), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _joiner(names: list[str]):
    """The checksums of documents that lie in several runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = [crc_joined([(p["crc"], 4 * p["n"]) for p in parts]) for parts in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) if c != "crc" else pa.array(crc, pa.int64()) for c in names], names)

    return run


def read_ids(spark: SparkSession, path: str, with_ids: bool = False, most_ids: int = 1 << 22) -> DataFrame:
    """Decodes the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and on request the ids.

    Every run between two checkpoints is decoded and checked by itself. Those of a block of more than `most_ids` ids (a long
    document) are spread over all tasks; documents that lie in several runs are joined afterwards. What is decoded is a written table, so the files may go afterwards.
    """
    blocks = spark.read.parquet(f"{path}/blocks")
    freq = read_table(spark, path)
    per_part = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # a row per part (as many as there were partitions): their running sum is a window over few rows
    before = per_part.select("part", F.expr("coalesce(sum(n) over (order by part rows between unbounded preceding and 1 preceding), 0)").alias("part_start"))
    starts = kept(blocks.select("part", "block", "n_ids").join(F.broadcast(before), "part").select("part", "block", F.expr("part_start + coalesce(sum(n_ids) over (partition by part order by block rows between unbounded preceding and 1 preceding), 0)").alias("first_start")), scratch(spark, "starts"))
    runs = runs_of(blocks.where(F.col("n_ids") <= most_ids))
    if blocks.where(F.col("n_ids") > most_ids).head(1):
        runs = runs.unionAll(runs_of(blocks.where(F.col("n_ids") > most_ids)).repartition("part", "block", "run"))
    with batches_of(spark, 4):  # a row is half a million ids
        decoded = kept(runs.mapInArrow(lean(_decoder(freq, with_ids)), DECODED + ", ids array<long>" * with_ids), scratch(spark, "decoded"))
    names = ["part", "block", "doc_id", "start", "n", "crc", *["ids"] * with_ids]
    split = decoded.where("not whole").groupBy("part", "block", "number").agg(F.first("doc_id").alias("doc_id"), F.first("start").alias("start"), F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("run", "n", "crc"))).alias("parts"), *[F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("run", "ids"))), lambda x: x["ids"])).alias("ids")] * with_ids)
    split = split.withColumn("crc", F.lit(0).cast("long")).select(*names, "parts").mapInArrow(lean(_joiner(names)), ", ".join(f"{c} {'array<long>' if c == 'ids' else 'int' if c in ('part', 'block') else 'long'}" for c in names))
    out = decoded.where("whole").select(*names).unionAll(split).join(starts, ["part", "block"]).withColumn("start", F.col("start") + F.col("first_start"))
    return out.select("doc_id", "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"), *["ids"] * with_ids)
