"""Best-fit packing of documents into sequences by hierarchical residual packing.

A document is its token ids and the end id; only documents longer than `size` are cut, into pieces of `size`
(the last may be shorter). Each partition packs its pieces by best-fit decreasing. Sequences with at most `slack`
free places are done. The others go up as items of their own used length: `fan` partitions meet in one task,
which packs again by best-fit, and so on until one group is left. A merged sequence keeps its contents' order,
so a piece's place is the sum of its offsets on the way up.

Bounded memory. A partition holds numbers, not ids. Open sequences of one used length are alike, so what meets in
a task is how many of each length every partition has: at most `size` numbers a partition, however many sequences
they are, and the packing is the same as if each sequence were packed by itself. A task gives runs of sequences,
(partition, used length, first to last) to (parent, offset), by which every open sequence then finds its way up.
Each round is a written table, so a lost executor cannot change a packing that later steps have read.

Defined cases. Null and empty texts: a piece with only the end id. Rows that share a doc_id are documents of
their own, with equal doc_id and piece numbers. A null doc_id stays null. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, batches_of, discard, kept, lean, scratch, slices
from .tokens import worker_tokenizer

PIECES = "kind int, part long, bin long, used int, place long, doc_id long, piece int, start long, length long, ids_crc32 long, offset long"
NAMES = [f.split()[0] for f in PIECES.split(", ")]
RUNS = "part long, used int, first long, last long, up_part long, up_used int, up_first long, number long, offset long, open boolean"
#: Runs that are sent to all executors rather than joined by a shuffle: at most so many rows of 80 bytes.
MOST_BROADCAST = 500_000


def fit_classes(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing of counts[n] items of each length n.

    Gives rows (length, first item, items, first bin, offset): so many items of that length, one to a bin, at that
    offset of as many bins in a row; and rows (first bin, bins, used), ascending, of bins that are used alike.
    """
    placed: list[tuple[int, int, int, int, int]] = []
    by_room: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]
    rooms = 0  # bit r: some bin has room r
    bins = 0

    def fill(room: int, first: int, n: int, length: int, item: int, left: int) -> int:
        """Gives n bins of that room the next items, each as many as it holds before the next one, which then has more room. How many items were placed."""
        nonlocal rooms
        each = room // length
        whole = min(n, left // each)
        rest = left - whole * each if whole < n else 0
        at = item
        for bins_, number, start in ((whole, each, first), (int(rest > 0), rest, first + whole)):
            if bins_:
                for k in range(number):
                    placed.append((length, at, bins_, start, size - room + k * length))
                    at += bins_
                by_room[room - number * length].append((start, bins_))
                rooms |= 1 << (room - number * length)
        begun = whole + (rest > 0)
        if begun < n:
            by_room[room].append((first + begun, n - begun))
            rooms |= 1 << room
        return at - item

    for length in range(size, 0, -1):
        left, item = int(counts[length]), 0
        while left:
            if fit := rooms >> length:
                room = length + (fit & -fit).bit_length() - 1
                first, n = by_room[room].pop()
                if not by_room[room]:
                    rooms ^= 1 << room
            else:
                room, first, n = size, bins, -(-left // (size // length))
                bins += n
            done = fill(room, first, n, length, item, left)
            left, item = left - done, item + done
    used = sorted((first, n, size - room) for room, groups in enumerate(by_room) for first, n in groups)
    return np.array(placed, np.int64).reshape(-1, 5), np.array(used, np.int64).reshape(-1, 3)


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each item's bin and offset, and each bin's used length. Equal items in their given order."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    begins = np.searchsorted(-lengths[order], -np.arange(size + 1))
    placed, used = fit_classes(np.bincount(lengths, minlength=size + 1), size)
    for length, item, n, first, offset in placed.tolist():
        who = order[begins[length] + item : begins[length] + item + n]
        bins[who], offsets[who] = np.arange(first, first + n), offset
    return bins, offsets, np.repeat(used[:, 2], used[:, 1])


def _among_alike(used: np.ndarray) -> np.ndarray:
    """Each bin's place among those that are used alike."""
    order = np.argsort(used, kind="stable")
    first = np.searchsorted(used[order], used[order])
    out = np.empty(len(used), np.int64)
    out[order] = np.arange(len(used)) - first
    return out


def _pieces(tokenizer: str, end: int, size: int, slack: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = worker_tokenizer(tokenizer, end), TaskContext.get().partitionId()
        docs, piece, length, crc = [], [], [], []
        for batch in batches:
            for rows, texts in slices(batch, "text", 1 << 20):
                ids, n = coder.encode(texts)
                view = memoryview(ids.astype("<u4").tobytes())
                k = -(-n // size)
                number = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
                own = np.minimum(size, np.repeat(n, k) - number * size)
                stop = 4 * np.cumsum(own)
                crc.append(np.array([zlib.crc32(view[a:b]) for a, b in zip((stop - 4 * own).tolist(), stop.tolist(), strict=True)], np.int64))
                docs.append(rows.column("doc_id").cast(pa.int64()).take(pa.array(np.repeat(np.arange(len(n)), k))))
                piece.append(number)
                length.append(own)
        if not docs:
            return
        lengths, pieces = np.concatenate(length), np.concatenate(piece)
        bins, offsets, used = best_fit(lengths, size)
        base = part << 32
        n = len(lengths)
        none = pa.nulls(n, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, part)), pa.array(bins + base), pa.nulls(n, pa.int32()), none, pa.concat_arrays(docs), pa.array(pieces.astype(np.int32)), pa.array(pieces * size), pa.array(lengths), pa.array(np.concatenate(crc)), pa.array(offsets)], NAMES)
        goes = np.flatnonzero(size - used > slack)
        m = len(goes)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), pa.array(np.full(m, part)), pa.array(goes + base), pa.array(used[goes].astype(np.int32)), pa.array(_among_alike(used[goes])), *(pa.nulls(m, t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], NAMES)

    return run


def merged(parts: np.ndarray, used: np.ndarray, n: np.ndarray, size: int, slack: int) -> list[tuple[int, ...]]:
    """Packs n sequences of each used length of each part; gives rows (part, used, first, last, up_used, up_first, number, offset, open)."""
    rank = np.lexsort((parts, used))
    parts, used, n = parts[rank], used[rank], n[rank]
    counts = np.bincount(used, weights=n, minlength=size + 1).astype(np.int64)
    placed, bins = fit_classes(counts, size)
    ends = np.cumsum(n)
    before = np.concatenate([[0], np.cumsum(counts)])[used]  # sequences of shorter lengths
    first_of, last_of = ends - n - before, ends - before  # a part's sequences among all of that length
    rows_of = np.searchsorted(used, np.arange(size + 2))
    alike = np.zeros(len(bins), np.int64)  # bins before these that are used alike
    for u in np.unique(bins[:, 2]):
        own = np.flatnonzero(bins[:, 2] == u)
        alike[own] = np.cumsum(bins[own, 1]) - bins[own, 1]
    starts = bins[:, 0]
    out = []
    for length, item, many, bin_, offset in placed.tolist():
        r = int(rows_of[length]) + int(np.searchsorted(last_of[rows_of[length] : rows_of[length + 1]], item, "right"))
        g = int(np.searchsorted(starts, bin_, "right")) - 1
        stop = item + many
        while item < stop:  # cut where another part's sequences or bins used otherwise begin
            k = min(stop - item, int(last_of[r]) - item, int(starts[g] + bins[g, 1]) - bin_)
            at = item - int(first_of[r])
            up_used = int(bins[g, 2])
            out.append((int(parts[r]), length, at, at + k, up_used, int(alike[g]) + bin_ - int(starts[g]), bin_, offset, size - up_used > slack))
            item, bin_ = item + k, bin_ + k
            r += item == last_of[r]
            g += bin_ == starts[g] + bins[g, 1]
    return out


def _merge(size: int, slack: int):
    names = ["part", "used", "first", "last", "up_used", "up_first", "number", "offset", "open"]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = pd.DataFrame(merged(*(group[c].to_numpy(np.int64) for c in ("part", "used", "n")), size, slack), columns=names)
        return rows.assign(up_part=int(group["up_part"].iloc[0]))[[f.split()[0] for f in RUNS.split(", ")]]

    return run


def pack(docs: DataFrame, size: int = 2048, tokenizer: str = "word_bpe_49k.json", end: int = 0, slack: int = 4, fan: int = 8, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    with batches_of(spark, 4 * BATCH_ROWS):  # more chunks repeat within a batch
        pieces_at = scratch(spark, "pieces")
        rows = kept(docs.select("doc_id", "text").mapInArrow(lean(_pieces(tokenizer, end, size, slack)), PIECES), pieces_at)
    pieces = rows.where("kind = 0").select("doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset")
    way = rows.where("kind = 1").select("bin", "part", "used", "place", F.lit(None).cast("long").alias("root"), F.lit(0).cast("long").alias("shift"))
    counts = way.groupBy("part", "used").agg(F.count("*").alias("n"))
    parts = int(rows.where("kind = 1").agg(F.max("part")).first()[0] or 0) + 1
    paths, level = [], 0
    while parts > 1 or not level:
        level, parts = level + 1, -(-parts // fan)
        paths.append(scratch(spark, "packed"))
        runs = kept(counts.withColumn("up_part", F.floor(F.col("part") / fan).cast("long")).groupBy("up_part").applyInPandas(_merge(size, slack), RUNS), paths[-1])
        few = runs.count() <= most_broadcast
        counts = runs.where("open and offset = 0").groupBy(F.col("up_part").alias("part"), F.col("up_used").alias("used")).agg(F.sum(F.col("last") - F.col("first")).alias("n"))
        # a sequence's number is its level's, its group's and its own within that
        step = (1 << 56) // parts
        on = (F.col("w.part") == F.col("r.part")) & (F.col("w.used") == F.col("r.used")) & (F.col("w.place") >= F.col("r.first")) & (F.col("w.place") < F.col("r.last"))
        along = F.col("w.place") - F.col("r.first")
        moved = way.alias("w").join((F.broadcast(runs) if few else runs).alias("r"), on, "left")
        stays = F.col("r.part").isNull()  # was done on a lower level
        way = moved.select(
            "w.bin",
            F.when(F.col("r.open"), F.col("r.up_part")).alias("part"),
            F.when(F.col("r.open"), F.col("r.up_used")).alias("used"),
            F.when(F.col("r.open"), F.col("r.up_first") + along).alias("place"),
            F.when(stays, F.col("w.root")).otherwise(F.lit(level << 56) + F.col("r.up_part") * step + F.col("r.number") + along).alias("root"),
            F.when(stays, F.col("w.shift")).otherwise(F.col("w.shift") + F.col("r.offset")).alias("shift"),
        )
    placed = way.select("bin", "root", "shift")
    joined = pieces.join(placed, "bin", "left").select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("root", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
    out = kept(joined, scratch(spark, "packing"))
    discard(spark, pieces_at, *paths)
    return out
