"""Suffix-array dedup: removes every byte inside a string of `length` bytes that also starts earlier.

Earlier: in a document of smaller doc_id, or in the same one further to the front. Texts are UTF-8 bytes; no
string crosses documents; strings are judged on the input.

1. Each window of `length` bytes is represented by its smallest hashed `gram`-byte gram, so equal windows
   have equal representatives. A first scan counts the representatives of all documents (a value per run of
   windows that one gram represents); those met twice are kept as sorted arrays in the shared folder. All other windows
   are unique: nothing is lost by leaving them out.
2. A representative of more than `heavy` runs (a short line in a third of all documents, say) would fill one shard.
   Its windows are cut out by a scan of their own and represented anew by longer grams, and where these are heavy too by all
   of their bytes (each time among what was cut out): equal windows still meet, and nothing heavy is left but copies of one window.
3. Another scan cuts out, for each run of windows with a repeated representative, the run's bytes, and deals
   them by the representative into shards of about `shard_bytes`. Equal strings always meet in one shard. Runs of
   equal bytes are collapsed to their earliest in each task and again in the shard, so that a passage which a
   third of all documents hold is sent once by each task.
4. Each shard's runs are written to a local file and sorted by suffix, with common-prefix values, by induction from
   disk-backed queues (`suffix_array`): suffixes that share `length` bytes stand together, and all but the earliest are marked.
   About `queue_items` items are held in memory, however large the shard.
5. Marked spans are gathered per document and cut out.

Defined cases. Null text: empty. Texts under `length` bytes lose nothing. A null doc_id comes after all others. Rows
that share a doc_id have the same rank: equal places of two of them are not earlier than each other, so what only they
share at one place stays in both. Kept bytes need not be valid UTF-8: cuts fall between bytes.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Lookup, cut, pack, save, shard_edges, summed, unpack
from .common import as_bytes, by_shard, discard, kept, lean, mix64, release, scratch, shards_for, slices, small_batches
from .suffix_array import BREAK, CAP, PAD, TAGGED, Column, Queues, by_place, descending

COUNTED = "shard int, keys binary, n binary"
RUNS = "shard int, docs binary, prints binary, starts binary, sizes binary, data binary, spans binary"
BLOCK = 1 << 15  # keys in a row: rows are small, as an Arrow batch holds many
LAST = (1 << 63) - 1  # stands for a null doc_id
RUN = np.dtype([("begin", "<i8"), ("size", "<i8"), ("doc", "<i8"), ("print", "<i8"), ("start", "<i8")])
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def series(base: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return series(BASE), series(pow(BASE, -1, 1 << 64))


def representatives(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of `length` bytes, the place of its smallest gram hash (by its first bits, then the leftmost), and the hashes of all grams."""
    n = len(data)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    power, inverse = _powers(1 << max(20, (n - 1).bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(data.astype(np.uint64) * power[:n], out=sums[1:])
    hashes = mix64((sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1])
    mask = np.uint64((1 << max(24, n.bit_length())) - 1)
    low = (hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64)
    wide, width = length - gram + 1, 1
    while 2 * width <= wide:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = wide - width
    return ((np.minimum(low[:-rest], low[rest:]) if rest else low) & mask).astype(np.int64), hashes


class Windows:
    """Joined texts, and which of their places begin a window of one text."""

    def __init__(self, texts: list[bytes | None], length: int) -> None:
        self.raw, self.length = b"".join(t or b"" for t in texts), length
        self.data = np.frombuffer(self.raw, np.uint8)
        sizes = np.array([len(t) if t else 0 for t in texts], np.int64)
        self.begins = np.cumsum(sizes) - sizes
        self.long = np.flatnonzero(sizes >= length)
        self.inside = np.zeros(max(0, len(self.data) - length + 1), bool)
        if len(self.long):
            edge = np.zeros(len(self.inside) + 1, np.int8)
            edge[self.begins[self.long]] += 1
            np.add.at(edge, self.begins[self.long] + sizes[self.long] - length + 1, -1)
            self.inside = np.cumsum(edge[:-1], dtype=np.int8) > 0
        self.wanted = self.inside

    def stretches(self) -> tuple[np.ndarray, np.ndarray]:
        """Where wanted windows stand one after the other: the first one's place, and their number. Each stretch lies in one text, as windows of two texts never touch."""
        change = np.flatnonzero(np.diff(self.wanted, prepend=False, append=False))
        return change[::2], change[1::2] - change[::2]

    def runs(self, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each run of wanted windows that the same gram represents: the text, first window, last window + 1 (places in the joined text), representative."""
        none = np.zeros(0, np.int64)
        if not self.wanted.any():
            return none, none, none, none.astype(np.uint64)
        begin, n = self.stretches()
        sizes = n + self.length - 1
        if 4 * sizes.sum() < 3 * len(self.data):  # only the bytes of wanted windows, joined
            to = np.cumsum(sizes) - sizes
            data = self.data[np.arange(sizes.sum()) + np.repeat(begin - to, sizes)]
        else:
            to, data = begin, self.data
        low, hashes = representatives(data, self.length, gram)
        at = np.arange(n.sum()) + np.repeat(to - np.cumsum(n) + n, n)
        low = low[at]
        new = np.concatenate([[True], low[1:] != low[:-1]])
        new[np.cumsum(n) - n] = True
        first = np.flatnonzero(new)
        keys = hashes[low[first]]
        stretch = np.searchsorted(np.cumsum(n), first, "right")
        place = at[first] + (begin - to)[stretch]
        last = place + np.diff(first, append=len(low))
        return self.long[np.searchsorted(self.begins[self.long], place, "right") - 1], place, last, keys

    def only(self, first: np.ndarray, last: np.ndarray) -> None:
        """From now on only the windows of these runs are wanted."""
        edge = np.zeros(len(self.wanted) + 1, np.int8)  # runs do not overlap
        edge[first] += 1
        edge[last] -= 1
        self.wanted = np.cumsum(edge[:-1], dtype=np.int8) > 0


def _texts(texts: list[bytes | None], column: str) -> list[bytes | None]:
    return texts if column == "text" else [x for t in texts for x in t.split(bytes([BREAK]))]


def _counter(length: int, gram: int, column: str, key_shards: int, flush: int = 1_000_000):
    """Counts the representatives of all windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            keys, _, n = summed(np.concatenate(held))
            edges = shard_edges(keys, key_shards)
            cuts = np.union1d(edges, np.arange(0, len(keys) + 1, BLOCK))
            if len(cuts) > 1:
                shard = np.searchsorted(edges, cuts[:-1], "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), cut(pack(keys, 8), 8 * cuts), cut(np.minimum(n, 65535).astype("<u2").tobytes(), 2 * cuts)], ["shard", "keys", "n"])

        for batch in batches:
            for _, texts in slices(batch, column, 512 << 10):
                keys = Windows(_texts(texts, column), length).runs(gram)[3]
                held.append(keys)
                size += len(keys)
                if size >= flush:
                    yield from out()
                    held, size = [], 0
        if held:
            yield from out()

    return run


def _heavy(length: int, gram: int, level: int, column: str, folder: str, key_shards: int, most: int = 64 << 10):
    """The stretches of windows with a heavy representative, each ended by BREAK, some in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = Lookup(folder, f"heavy{level}", key_shards)
        for batch in batches:
            for _, texts in slices(batch, column, 512 << 10):
                windows = Windows(_texts(texts, column), length)
                _, first, last, keys = windows.runs(gram)
                more = heavy.has(keys)
                if not more.any():
                    continue
                windows.only(first[more], last[more])
                begin, n = windows.stretches()
                ends = np.cumsum(n + length)
                cuts = [0, *(np.flatnonzero(ends[1:] // most > ends[:-1] // most) + 1).tolist(), len(n)]
                pieces = [windows.raw[i:j] for i, j in zip(begin.tolist(), (begin + n + length - 1).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([bytes([BREAK]).join(pieces[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], ["stretches"])

    return run


def _repeated(folder: str, level: int, heavy: int):
    def run(key: tuple[int, ...], group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = [], []
        for batch in group:
            keys += [unpack(k.as_py(), 8) for k in batch.column("keys")]
            n += [np.frombuffer(x.as_py(), "<u2") for x in batch.column("n")]
        distinct, _, total = summed(np.concatenate(keys), np.concatenate(n).astype(np.int64))
        save(folder, f"gram{level}.{key[0]}.key", distinct[total > 1].astype("<u8"))
        many = total > heavy
        if many.any():
            save(folder, f"heavy{level}.{key[0]}.key", distinct[many].astype("<u8"))
        light = (total > 1) & ~many
        yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()) for x in (total[light].sum(), total[many].sum(), many.sum())], ["runs", "heavy_runs", "heavies"])

    return run


def _row(shard: int, docs: list[int], prints: list[int], starts: list[int], data: list[bytes], spans: np.ndarray) -> pa.RecordBatch:
    values = [np.array(x, "<i8").tobytes() for x in (docs, prints, starts, [len(d) for d in data])]
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *(pa.array([v], pa.binary()) for v in (*values, b"".join(data), spans.tobytes()))], [f.split()[0] for f in RUNS.split(", ")])


def united(spans: np.ndarray) -> np.ndarray:
    """Rows (doc, print, begin, stop), those of one document that overlap or touch as one."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans[:, 2], spans[:, 1], spans[:, 0]))]
    other = np.concatenate([[True], (spans[1:, :2] != spans[:-1, :2]).any(axis=1)])
    far = np.cumsum(other) << 41  # a document's places are below this
    reach = np.maximum.accumulate(far + spans[:, 3])
    new = other | np.concatenate([[True], far[1:] + spans[1:, 2] > reach[:-1]])
    first = np.flatnonzero(new)
    out = spans[first]
    out[:, 3] = (reach - far)[np.append(first[1:], len(spans)) - 1]
    return out


class Collapsed:
    """Runs of bytes with their earliest places; the spans of all other places."""

    def __init__(self) -> None:
        self.runs: dict[bytes, tuple[int, int, int]] = {}
        self.same: dict[bytes, set[tuple[int, int, int]]] = {}
        self.later: list[tuple[int, int, int, int]] = []

    def add(self, data: bytes, place: tuple[int, int, int]) -> bool:
        """place: doc, start, print. Whether the run is new."""
        was = self.runs.setdefault(data, place)
        if was is place:
            return True
        if was[:2] == place[:2]:  # of rows that share a doc_id neither is earlier: both travel
            if was[2] != place[2]:
                self.same.setdefault(data, set()).add(place)
            return False
        if place < was:
            self.runs[data], place = place, was
        self.later.append((place[0], place[2], place[1], place[1] + len(data)))
        return False

    def items(self) -> list[tuple[bytes, tuple[int, int, int]]]:
        return [*self.runs.items(), *((data, p) for data, places in self.same.items() for p in places)]

    def spans(self) -> np.ndarray:
        return united(np.array(self.later, "<i8").reshape(-1, 4))


def _cutter(length: int, grams: tuple[int, ...], folder: str, key_shards: int, shards: int, flush: int = 24 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated = [Lookup(folder, f"gram{k}", key_shards) for k in range(len(grams))]
        heavy = [Lookup(folder, f"heavy{k}", key_shards) for k in range(len(grams) - 1)]
        held: dict[int, Collapsed] = {}
        size = later = turn = 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal turn
            for s, own in held.items():
                items = own.items()
                ends = np.cumsum([len(data) for data, _ in items])
                cuts = [0, *np.flatnonzero(ends[1:] // (8 * BLOCK) > ends[:-1] // (8 * BLOCK)) + 1, len(items)] if items else []
                for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                    docs, starts, prints = zip(*(p for _, p in items[i:j]), strict=True)
                    yield _row(s, docs, prints, starts, [data for data, _ in items[i:j]], np.zeros((0, 4), "<i8"))
            spans = united(np.concatenate([own.spans() for own in held.values()])) if held else np.zeros((0, 4), "<i8")
            for i in range(0, len(spans), BLOCK // 4):  # these are done; every shard takes its share of them along
                part = spans[i : i + BLOCK // 4]
                yield _row(int(mix64(part[:1, 0])[0] + np.uint64(turn)) % shards, [], [], [], [], part)
                turn += 1
            held.clear()

        for batch in batches:
            for rows, texts in slices(batch, "text", 512 << 10):
                windows = Windows(texts, length)
                docs = rows.column("doc_id").fill_null(LAST).to_numpy(zero_copy_only=False)
                prints = rows.column("print").to_numpy(zero_copy_only=False)
                for k, gram in enumerate(grams):
                    owner, first, last, keys = windows.runs(gram)
                    if not len(keys):
                        break
                    more = heavy[k].has(keys) if k < len(heavy) else np.zeros(len(keys), bool)
                    some = np.flatnonzero(repeated[k].has(keys) & ~more)
                    shard = (mix64(keys[some] + np.uint64(k)) % np.uint64(shards)).astype(np.int64).tolist()
                    own = owner[some]
                    begin, stop = first[some], last[some] + length - 1
                    for s, d, p, a, i, j in zip(shard, docs[own].tolist(), prints[own].tolist(), (begin - windows.begins[own]).tolist(), begin.tolist(), stop.tolist(), strict=True):
                        if s not in held:
                            held[s] = Collapsed()
                        if held[s].add(windows.raw[i:j], (d, a, p)):
                            size += j - i
                        else:
                            later += 1
                    if not more.any():
                        break
                    windows.only(first[more], last[more])
                if size >= flush or later > 500_000:
                    yield from out()
                    size = later = 0
        yield from out()

    return run


class Shard:
    """A shard's runs on disk: their bytes, each ended by BREAK, and where each stands in the documents."""

    def __init__(self) -> None:
        self.text, self.runs = Column("u1"), Column(RUN)

    def add(self, own: Collapsed) -> None:
        items = own.items()
        if items:
            sizes = np.array([len(data) for data, _ in items], np.int64)
            rows = np.empty(len(items), RUN)
            rows["begin"], rows["size"] = self.text.size + np.cumsum(sizes + 1) - sizes - 1, sizes
            for name, k in (("doc", 0), ("start", 1), ("print", 2)):
                rows[name] = [p[k] for _, p in items]
            self.runs.append(rows)
            self.text.append(np.frombuffer(bytes([BREAK]).join(data for data, _ in items) + bytes([BREAK]), np.uint8))

    def marked(self, length: int, memory: int, block: int) -> Iterator[np.ndarray]:
        """Rows (doc, print, begin, stop) of the windows that also start earlier: suffix order puts equal windows together."""
        n = self.text.size
        if not n:
            return
        self.text.append(np.zeros(PAD, np.uint8))
        text, runs = self.text.mapped(), self.runs.mapped()
        begins = runs["begin"]
        width = max(1, -(-n // (1 + 4 * n // memory)))
        found = Queues(-(-n // width), TAGGED, memory // 4, block)
        best = np.zeros(0, RUN), np.zeros(0, np.int64)  # the earliest windows so far of the group that is open: runs and places
        for at, lcp in descending(text, n, memory, block):
            tied = lcp >= length
            group = np.cumsum(~tied)
            member = tied | np.append(tied[1:], True)
            at_, group_ = at[member], group[member]
            own = runs[np.searchsorted(begins, at_, "right") - 1]
            good = at_ - own["begin"] + length <= own["size"]
            own = np.concatenate([best[0], own[good]])
            at_ = np.concatenate([best[1], at_[good]])
            group_ = np.concatenate([np.zeros(len(best[1]), np.int64), group_[good]])
            place = own["start"] + at_ - own["begin"]
            order = np.lexsort((place, own["doc"], group_))
            own, at_, group_, place = own[order], at_[order], group_[order], place[order]
            head = np.concatenate([[True], group_[1:] != group_[:-1]])[: len(at_)]
            least = np.maximum.accumulate(np.where(head, np.arange(len(at_)), 0))
            earliest = (own["doc"] == own["doc"][least]) & (place == place[least])
            by_place(found, at_[~earliest], np.zeros(int((~earliest).sum()), np.int64), width)
            still = earliest & (group_ == group[-1])
            best = own[still], at_[still]
        for queue in range(len(found.parts)):
            at, _ = found.whole(queue)
            if len(at):
                at = np.sort(at)
                run = np.searchsorted(begins, at, "right") - 1
                first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (run[1:] != run[:-1])]))
                last = np.append(first[1:], len(at)) - 1
                own = runs[run[first]]
                begin = own["start"] + at[first] - own["begin"]
                yield np.stack([own["doc"], own["print"], begin, begin + (at[last] - at[first]) + length], axis=1)


def _sorter(length: int, memory: int, block: int):
    def run(key: tuple[int, ...], group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, size = Shard(), Collapsed(), 0

        def out(spans: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(spans[:, k].copy()) for k in range(4)], ["doc", "print", "begin", "stop"])

        for batch in group:
            for r in range(batch.num_rows):
                docs, prints, starts, sizes = (np.frombuffer(batch.column(c)[r].as_py(), "<i8").tolist() for c in ("docs", "prints", "starts", "sizes"))
                data, i = batch.column("data")[r].as_py(), 0
                if len(spans := np.frombuffer(batch.column("spans")[r].as_py(), "<i8").reshape(-1, 4)):
                    yield out(spans)
                for d, p, a, n in zip(docs, prints, starts, sizes, strict=True):
                    size += n * held.add(data[i : i + n], (d, a, p))
                    i += n
                if size > 4 * memory or len(held.later) > 500_000:
                    shard.add(held)
                    yield out(held.spans())
                    held, size = Collapsed(), 0
        shard.add(held)
        yield out(held.spans())
        del held
        for spans in shard.marked(length, memory, block):
            yield out(united(spans))

    return run


def _remover(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(as_bytes(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
                text = text or b""
                if not spans:
                    rows.append((len(text), 0, 0, text))
                    continue
                out, at, runs, gone = [], 0, 0, 0
                end = -1
                for s in sorted((s["begin"], s["stop"]) for s in spans):
                    if s[0] > end:
                        runs += 1
                        out.append(text[at : s[0]])
                    gone += max(0, s[1] - max(s[0], end))
                    end = max(end, s[1])
                    at = end
                out.append(text[at:])
                rows.append((len(text), gone, runs, b"".join(out)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary())))], names)

    return run


def remove_repeats(docs: DataFrame, length: int = 100, gram: int = 24, shard_bytes: int = 8 << 20, queue_items: int = 3 << 20, heavy: int | None = None, block: int = 1 << 18) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (the remaining bytes) of every document.

    length: below CAP, where common-prefix values stop. heavy: runs of one representative from which on it is split; a quarter of a shard by default.
    """
    if not gram < length < CAP:
        raise ValueError(f"gram must be below length, and length below {CAP}")
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("print"))
    key_shards = shards_for(docs, 2 * shard_bytes)
    heavy = min(60_000, shard_bytes // (4 * length)) if heavy is None else heavy
    folder = scratch(spark, "repeated-grams")
    levels = (gram, (gram + length) // 2, length)
    size = used = 0
    source, column, stretches = rows.select("text"), "text", []
    for used in range(1, len(levels) + 1):
        last = used == len(levels)  # by all bytes of a window: what is met often now is one window, and collapses
        counted = by_shard(source.mapInArrow(lean(_counter(length, levels[used - 1], column, key_shards)), COUNTED), key_shards, _repeated(folder, used - 1, 1 << 62 if last else heavy), "runs long, heavy_runs long, heavies long", "shard")
        n = counted.agg(F.sum("runs").alias("runs"), F.sum("heavies").alias("heavies")).first()
        size += (n["runs"] or 0) * (length + (length - levels[used - 1]) // 2)
        del counted
        release(spark)
        if not n["heavies"]:
            break
        stretches.append(scratch(spark, "heavy-windows"))
        source = kept(source.mapInArrow(lean(_heavy(length, levels[used - 1], used - 1, column, folder, key_shards)), "stretches binary"), stretches[-1])
        column = "stretches"
    discard(spark, *stretches)
    shards = max(1, math.ceil(size / shard_bytes))
    cut_out = rows.mapInArrow(lean(_cutter(length, levels[:used], folder, key_shards, shards)), RUNS)
    spans_at = scratch(spark, "spans")
    spans = kept(by_shard(cut_out, shards, _sorter(length, queue_items, block), "doc long, print long, begin long, stop long", "shard"), spans_at)
    del cut_out
    release(spark)
    discard(spark, folder)
    # a document's spans are at most as many as its bytes
    per = spans.groupBy("doc", "print").agg(F.collect_list(F.struct("begin", "stop")).alias("spans"))
    both = rows.join(per, (F.coalesce("doc_id", F.lit(LAST)) == F.col("doc")) & (rows["print"] == per["print"]), "left").select("doc_id", "text", "spans")
    return both.mapInArrow(lean(_remover(["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
