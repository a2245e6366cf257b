"""LM scoring: an interpolated modified Kneser-Ney n-gram model counted in Spark, stored as sorted hash arrays.

Tokens: the text with A-Z lower-cased, cut into words `[^\\x20\\x09-\\x0D]+`, then one end token. Null and empty
texts are their end token. Contexts before a text's first word are a begin token, which is never predicted.

Counting. Workers hash words to 64 bits, an n-gram to a hash of its context's and its suffix's hash, and sort
and count about `flush` tokens at a time; what a task has counted goes to the shuffle as sorted arrays, dealt by
the n-gram's own hash, so a frequent word or context weighs no more than any other. A shard, of about `shard_bytes` of
input whatever the size of the whole, is a task of its own; it merges its arrays and yields its n-grams' adjusted counts (raw counts at the highest order, the number of distinct left neighbours
below), and for contexts and suffixes partial sums that are merged by their own hashes in a further step.
`key_bytes` bytes of a context's or suffix's hash travel (5: 40 bits); two words that share them share bigrams,
which at 10 million words happens to about one in 100,000. Single words keep all 64 bits.

Model. For each order, files of sorted 64-bit keys with counts and files of sorted contexts with totals and
back-off weights, cut into shards by the keys' first bits. They lie in the shared folder; workers map them into
memory, so only pages they touch are read and all workers of a machine share them. Where the shared folder is no
mounted one, pyarrow's file systems carry the files, and a worker maps copies in its own temporary folder.

p(w|h) = (a(hw) - D(a)) / a(h.) + gamma(h) p(w|h'), down to single words, interpolated with 1 / (V + 1) for
V known tokens and the unknown one. Discounts are Chen and Goodman's, from counts of counts 1 to 4; if one of
these is 0 or a discount leaves its range, 0.5, 1 and 1.5 are taken.

Rows that share a doc_id are scored each for itself; a null doc_id belongs to the training part. With no training
row every token is unknown: V = N = 0, and score and base are those of the uniform model over one token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import Lookup, cut, pack, save, shard_edges, summed, unpack
from .common import by_shard, discard, kept, lean, mix64, release, scratch, shards_for, slices, small_batches

BLOCKS = "kind string, ord int, shard int, a binary, b binary, n binary"
NAMES = ["kind", "ord", "shard", "a", "b", "n"]
BLOCK = 1 << 15  # n-grams in a row: rows are small, as an Arrow batch holds many
FULL = 255
END, BEGIN = xxhash.xxh3_64_intdigest(b"end", 1), xxhash.xxh3_64_intdigest(b"begin", 2)


class WordHashes(dict):
    def __missing__(self, word: bytes | None) -> int:
        self[word] = h = END if word is None else xxhash.xxh3_64_intdigest(word)
        return h


def token_hashes(texts: list[bytes | None], known: WordHashes, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """The tokens' hashes in order, and each text's number of tokens."""
    if len(known) > most:
        known.clear()
    words: list[bytes | None] = []
    sizes = np.ones(len(texts), np.int64)
    for i, text in enumerate(texts):
        if text:
            own = text.lower().split()
            words += own
            sizes[i] += len(own)
        words.append(None)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), sizes


def levels(hashes: np.ndarray, sizes: np.ndarray, order: int, drop: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For orders 2 to `order`: context and suffix of the n-gram that ends at each token, as hashes cut by `drop` bits."""
    pads = order - 1
    n = int(sizes.sum())
    place = np.arange(n) + np.repeat((np.arange(len(sizes)) + 1) * pads, sizes)
    low = np.full(n + pads * len(sizes), BEGIN, np.uint64)
    low[place] = hashes
    out = []
    cut = np.uint64(drop)
    for _ in range(2, order + 1):
        context = np.concatenate([np.array([BEGIN], np.uint64), low[:-1]]) >> cut
        suffix = low >> cut
        out.append((context[place], suffix[place]))
        low = key_of(context, suffix)
    return out


def key_of(context: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    return mix64(context * np.uint64(3) + mix64(suffix))


def narrow(columns: list[np.ndarray]) -> bytes:
    """Columns of numbers, each in the fewest bytes that hold all of it, and which that is."""
    out = []
    for x in columns:
        kind = np.min_scalar_type(int(x.max())) if len(x) else np.dtype("u1")
        out += [bytes([kind.itemsize]), x.astype(kind).tobytes()]
    return b"".join(out)


def widened(raw: bytes, n: int) -> list[np.ndarray]:
    """The columns of n numbers as 64-bit ones."""
    out, at = [], 0
    while at < len(raw):
        out.append(np.frombuffer(raw, f"<u{raw[at]}", n, at + 1).astype(np.int64))
        at += 1 + n * raw[at]
    return out


def _rows(kind: str, order: int, shards: int, route: np.ndarray, bits: int, a: tuple[np.ndarray, int], b: tuple[np.ndarray, int] | None, n: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Blocks by shard: the first bits of `route` (a `bits`-bit number, ascending)."""
    edges = shard_edges(route, shards, bits)
    cuts = np.union1d(edges, np.arange(0, len(route) + 1, BLOCK))
    first, last = cuts[:-1], cuts[1:]
    if not len(first):
        return
    shard = np.searchsorted(edges, first, "right") - 1
    rows = lambda x: cut(pack(x[0], x[1]), cuts * x[1])
    same = len(first)
    numbers = pa.array([narrow([x[i:j] for x in n]) for i, j in zip(first.tolist(), last.tolist(), strict=True)], pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array([kind] * same), pa.array(np.full(same, order, np.int32)), pa.array(shard.astype(np.int32)), rows(a), rows(b) if b else pa.array([b""] * same, pa.binary()), numbers], NAMES)


def _count(order: int, shards: int, width: int, flush: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            hashes, sizes = np.concatenate([h for h, _ in held]), np.concatenate([s for _, s in held])
            keys, _, n = summed(hashes)
            yield from _rows("raw", 1, shards, keys, 64, (keys, 8), None, [n])
            for k, (context, suffix) in enumerate(levels(hashes, sizes, order, 64 - 8 * width), 2):
                keys, at, n = summed(key_of(context, suffix))
                yield from _rows("raw", k, shards, keys, 64, (context[at], width), (suffix[at], width), [n])

        for batch in batches:
            for _, texts in slices(batch, "text"):
                held.append(token_hashes(texts, known))
                size += len(held[-1][0])
                if size >= flush:
                    yield from out()
                    held, size = [], 0
        if held:
            yield from out()

    return run


# ---- merging

def _read(group: Iterator[pa.RecordBatch], *kinds: str) -> dict[str, list[tuple[bytes, bytes, bytes]]]:
    """The blocks of a group by their kind."""
    out: dict[str, list[tuple[bytes, bytes, bytes]]] = {k: [] for k in kinds}
    for batch in group:
        for k, a, b, n in zip(*(batch.column(c).to_pylist() for c in ("kind", "a", "b", "n")), strict=True):
            if k in out:
                out[k].append((a, b, n))
    return out


def _numbers(parts: list[tuple[bytes, bytes, bytes]], width: int) -> list[np.ndarray]:
    """The columns of numbers of all blocks, in a row. width: of a block's keys a."""
    found = [widened(n, len(a) // width) for a, _, n in parts]
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)]


def _summed(order: int, shard: int, a: bytes, b: bytes, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(["sum"]), pa.array([order], pa.int32()), pa.array([shard], pa.int32()), pa.array([a], pa.binary()), pa.array([b], pa.binary()), pa.array([narrow([n])], pa.binary())], NAMES)


def _small(kind: str, order: int, shard: int, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([order], pa.int32()), pa.array([shard], pa.int32()), pa.array([b""], pa.binary()), pa.array([b""], pa.binary()), pa.array([values.astype("<i8").tobytes()], pa.binary())], NAMES)


def _finish(folder: str, order: int, top: int, shards: int, width: int, shard: int, context: np.ndarray, suffix: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A shard's n-grams (ascending keys, adjusted counts): its files, partial sums by context and by suffix, counts of counts."""
    save(folder, f"gram{order}.{shard}.key", keys.astype("<u8"))
    save(folder, f"gram{order}.{shard}.n", np.minimum(counts, FULL).astype("u1"))
    many = counts >= FULL  # few n-grams are met so often: their counts stand in files of their own
    save(folder, f"many{order}.{shard}.key", keys[many].astype("<u8"))
    save(folder, f"many{order}.{shard}.n", counts[many].astype("<u8"))
    bits = 8 * width
    own, _, _ = summed(context)
    which = np.searchsorted(own, context)
    total = np.bincount(which, weights=counts, minlength=len(own))
    by = [np.bincount(which[counts == c if c < 3 else counts >= 3], minlength=len(own)) for c in (1, 2, 3)]
    yield from _rows("context", order, shards, own, bits, (own, width), None, [total, *by])
    own, _, n = summed(suffix)
    yield from _rows("left", order - 1, shards, own, bits, (own, width), None, [n])
    yield _small("seen", order, shard, np.array([(counts == c).sum() for c in (1, 2, 3, 4)]))


def _merge_raw(folder: str, top: int, shards: int, width: int):
    """Groups of one order and shard: the highest order is finished, lower ones are merged and handed on."""

    def run(key: tuple[int, ...], group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, order = key
        parts = _read(group, "raw")["raw"]
        if order == 1:
            keys, _, n = summed(np.concatenate([unpack(p[0], 8) for p in parts]), _numbers(parts, 8)[0])
            yield _summed(1, shard, pack(keys, 8), b"", n)
            return
        context, suffix = (np.concatenate([unpack(p[k], width) for p in parts]) for k in (0, 1))
        keys, at, n = summed(key_of(context, suffix), _numbers(parts, width)[0])
        if order == top:
            yield from _finish(folder, order, top, shards, width, shard, context[at], suffix[at], keys, n)
        else:
            yield _summed(order, shard, pack(context[at], width), pack(suffix[at], width), n)

    return run


def _merge_lower(folder: str, order: int, top: int, shards: int, width: int):
    """A shard of a lower order: its merged n-grams meet the numbers of their left neighbours."""
    cut = np.uint64(64 - 8 * width)

    def run(key: tuple[int, ...], group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = key[0]
        rows = _read(group, "sum", "left")
        sums, left = rows["sum"], rows["left"]
        if not sums:
            return
        number = _numbers(sums, 8 if order == 1 else width)[0]
        seen, _, lefts = summed(np.concatenate([unpack(p[0], width) for p in left] or [np.zeros(0, np.uint64)]), _numbers(left, width)[0])

        def adjusted(keys: np.ndarray) -> np.ndarray:
            if not len(seen):
                return np.zeros(len(keys), np.int64)
            at = np.minimum(np.searchsorted(seen, keys >> cut), len(seen) - 1)
            return np.where(seen[at] == keys >> cut, lefts[at], 0)

        if order == 1:
            keys = np.concatenate([unpack(p[0], 8) for p in sums])
            a = adjusted(keys)
            save(folder, f"word.{shard}.key", keys.astype("<u8"))
            save(folder, f"word.{shard}.count", number.astype("<u8"))
            save(folder, f"word.{shard}.n", a.astype("<u8"))
            yield _small("seen", 1, shard, np.array([*((a == c).sum() for c in (1, 2, 3, 4)), len(keys), number.sum(), a.sum(), (a >= 3).sum()]))
            return
        context, suffix = (np.concatenate([unpack(p[k], width) for p in sums]) for k in (0, 1))
        keys = key_of(context, suffix)
        begins = context == np.uint64(BEGIN) >> cut  # no left neighbour: the count itself
        a = np.where(begins, number, adjusted(keys))
        some = a > 0
        yield from _finish(folder, order, top, shards, width, shard, context[some], suffix[some], keys[some], a[some])

    return run


def discounts(seen: np.ndarray) -> tuple[float, float, float]:
    n1, n2, n3, n4 = (int(x) for x in seen[:4])
    if min(n1, n2, n3, n4) > 0:
        y = n1 / (n1 + 2 * n2)
        d = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
        if all(0 <= x <= k for k, x in enumerate(d, 1)):
            return d
    return 0.5, 1.0, 1.5


def _merge_contexts(folder: str, order: int, width: int, d: tuple[float, float, float]):
    def run(key: tuple[int, ...], group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = key[0]
        parts = _read(group, "context")["context"]
        keys = np.concatenate([unpack(p[0], width) for p in parts])
        stats = np.stack(_numbers(parts, width))
        rank = np.argsort(keys, kind="stable")
        k = keys[rank]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        total, *by = np.add.reduceat(stats[:, rank], first, axis=1)
        save(folder, f"context{order}.{shard}.key", k[first].astype("<u8"))
        save(folder, f"context{order}.{shard}.total", total.astype("<f8"))
        save(folder, f"context{order}.{shard}.gamma", (sum(x * n for x, n in zip(d, by, strict=True)) / total).astype("<f4"))
        yield _small("done", order, shard, np.array([len(first)]))

    return run


class Model:
    """Where the arrays lie and the few numbers that belong to them."""

    def __init__(self, folder: str, order: int, shards: int, width: int, d: dict[int, tuple[float, float, float]], kinds: int, tokens: int, lefts: int, gamma: float) -> None:
        self.folder, self.order, self.shards, self.width, self.d = folder, order, shards, width, d
        self.kinds, self.tokens, self.lefts, self.gamma = kinds, tokens, lefts, gamma


def train(docs: DataFrame, order: int = 2, shards: int | None = None, key_bytes: int = 5, flush: int = 3_000_000, shard_bytes: int = 8 << 20) -> Model:
    """Counts the texts of docs. order: 2 or 3. shards: a power of two; by default one for so many bytes of input, as Spark estimates it.

    Each shard sends every other one what it has found of its contexts and suffixes, at most a number per n-gram.
    """
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    spark = docs.sparkSession
    small_batches(spark)
    shards = shards or shards_for(docs, shard_bytes)
    folder = scratch(spark, "kneser-ney")
    counted = docs.select("text").mapInArrow(lean(_count(order, shards, key_bytes, flush)), BLOCKS)
    paths = [scratch(spark, "ngrams")]
    rows = kept(by_shard(counted, shards, _merge_raw(folder, order, shards, key_bytes), BLOCKS, "shard", "ord"), paths[0])
    del counted
    release(spark)
    d: dict[int, tuple[float, float, float]] = {}
    for k in range(order, 0, -1):
        if k < order:
            paths.append(scratch(spark, "ngrams"))
            below = rows.where((F.col("ord") == k) & F.col("kind").isin("sum", "left"))
            rows = rows.unionAll(kept(by_shard(below, shards, _merge_lower(folder, k, order, shards, key_bytes), BLOCKS, "shard"), paths[-1]))
        seen = [np.frombuffer(bytes(r[0]), "<i8") for r in rows.where((F.col("ord") == k) & (F.col("kind") == "seen")).select("n").toLocalIterator()]
        total = np.sum(seen, axis=0) if seen else np.zeros(8, np.int64)
        d[k] = discounts(total)
        if k > 1:
            made = by_shard(rows.where((F.col("ord") == k) & (F.col("kind") == "context")), shards, _merge_contexts(folder, k, key_bytes, d[k]), BLOCKS, "shard")
            made.agg(F.count("*")).collect()  # the files are what it is for
    kinds, tokens, lefts, many = (int(x) for x in total[4:])
    gamma = (d[1][0] * int(total[0]) + d[1][1] * int(total[1]) + d[1][2] * many) / lefts if lefts else 1.0
    discard(spark, *paths)
    return Model(folder, order, shards, key_bytes, d, kinds, tokens, lefts, gamma)


class Scorer:
    def __init__(self, m: Model) -> None:
        self.m, self.known = m, WordHashes()
        self.words = Lookup(m.folder, "word", m.shards, 64, {"count": "<u8", "n": "<u8"})
        self.grams = {k: Lookup(m.folder, f"gram{k}", m.shards, 64, {"n": "u1"}) for k in range(2, m.order + 1)}
        self.many = {k: Lookup(m.folder, f"many{k}", m.shards, 64, {"n": "<u8"}) for k in range(2, m.order + 1)}
        self.contexts = {k: Lookup(m.folder, f"context{k}", m.shards, 8 * m.width, {"total": "<f8", "gamma": "<f4"}) for k in range(2, m.order + 1)}

    @staticmethod
    def _less(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
        return np.maximum(n - np.array([0.0, *d])[np.minimum(n, 3).astype(np.int64)], 0)

    def __call__(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, known tokens, base score and score of each text."""
        m = self.m
        hashes, sizes = token_hashes(texts, self.known)
        one = self.words(hashes, {"count": 0, "n": 0})
        p = self._less(one["n"], m.d[1]) / max(m.lefts, 1) + m.gamma / (m.kinds + 1)
        for k, (context, suffix) in enumerate(levels(hashes, sizes, m.order, 64 - 8 * m.width), 2):
            keys = key_of(context, suffix)
            own = self.grams[k](keys, {"n": 0})["n"]
            if len(full := np.flatnonzero(own == FULL)):
                own[full] = self.many[k](keys[full], {"n": FULL})["n"]
            at = self.contexts[k](context, {"total": 1, "gamma": 1})
            p = self._less(own, m.d[k]) / at["total"] + at["gamma"] * p
        owner = np.repeat(np.arange(len(sizes)), sizes)
        add = lambda x: np.bincount(owner, weights=x, minlength=len(sizes))
        base = np.log10((one["count"] + 0.5) / (m.tokens + 0.5 * (m.kinds + 1)))
        return sizes, add(one["count"] > 0).astype(np.int64), add(base), add(np.log10(p))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score (both log10) of every document; perplexity is 10 ** (-score / n_tokens)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for rows, texts in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), *(pa.array(x) for x in scorer(texts))], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n_tokens long, n_known long, base_score double, score double")


def remove(spark: SparkSession, model: Model) -> None:
    discard(spark, model.folder)
