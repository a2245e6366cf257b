"""MinHash near-dedup by circulant permutations: candidates from bands, links from exact Jaccard on full sets.

A document's set: its distinct `shingle`-word shingles (A-Z lower-cased, words `[^\\x20\\x09-\\x0D]+`); with
fewer words the whole sequence is the only one; without words the set is empty and linked with nothing.
Shingles are 64-bit hashes, of which two differ by chance once in 10**19.

Signatures. Two permutations of the 32-bit numbers: the first shuffles a shingle's number, the second, shifted
circularly by k, gives coordinate k: the smallest value over the set. `bands` bands of `rows` coordinates
each; at similarity 0.85 all 32 bands of 5 miss a pair once in 10**8, at 0.8 three times in a million.

Classes. Documents with one and the same set form a class, found by a fingerprint of the set before anything is
paired; its smallest doc_id stands for it. Within a bucket no list of all pairs is made: every member is held
against one centre, the one that shares most buckets (the original of many copies, as a rule); links give
components, and only members of different components are looked at again, `rounds` times in all, against the
best of those that are not in the first centre's component. What then still shares a bucket with another
component is paired exactly, however similar or not: of two sets similar enough, the rarest shingles (as many as the
threshold lets one set have alone, and one more) have one in common, so only documents that share a rare
shingle meet. A passage that thousands of documents hold is not rare and pairs nobody. No link between members of different
components that share a bucket is lost.

Plan. One scan makes counts, fingerprints and bands. Texts of candidates are read in a second scan (their ids are
broadcast while they are at most `most_broadcast_ids`, joined by a shuffle beyond). Components are found by
alternating large-star and small-star steps over written tables.

Defined cases. Null and empty texts: n_shingles 0, a component of their own, kept. A null doc_id: its row stays,
component_id null, kept true, linked with nothing. Rows that share a doc_id are one document; its set is that of
each row, so it links what any of them links, and n_shingles is given row by row.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, discard, kept, lean, mix64, scratch, slices, small_batches

SIGNED = "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>"


class Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes], most: int = 200_000) -> np.ndarray:
        if len(self) > most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one document's word hashes."""
    n = len(hashes)
    if not n:
        return hashes
    span = min(n, size)
    key = np.full(n - span + 1, span, np.uint64)
    for k in range(span):
        key = mix64(key * np.uint64(5) + hashes[k : n - span + 1 + k])
    return np.unique(key)


def sets_of(texts: list[bytes | None], words: Words, size: int) -> list[np.ndarray]:
    return [shingles(words.of(t.lower().split()), size) if t else np.zeros(0, np.uint64) for t in texts]


def _mix32(x: np.ndarray, a: int, b: int, tmp: np.ndarray) -> None:
    """A bijection of 32-bit numbers, in place."""
    for shift, factor in ((16, a), (15, b), (16, None)):
        np.right_shift(x, np.uint32(shift), out=tmp)
        np.bitwise_xor(x, tmp, out=x)
        if factor is not None:
            np.multiply(x, np.uint32(factor), out=x)


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """One column of smallest values per (non-empty) set."""
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    flat = np.concatenate(sets)
    first = (flat ^ (flat >> np.uint64(32))).astype(np.uint32)
    tmp, value = np.empty_like(first), np.empty_like(first)
    _mix32(first, 0x7FEB352D, 0x846CA68B, tmp)
    out = np.empty((coordinates, len(sets)), np.uint32)
    for k in range(coordinates):
        np.add(first, np.uint32(k), out=value)
        _mix32(value, 0x9E3779B1, 0x85EBCA6B, tmp)
        out[k] = np.minimum.reduceat(value, starts)
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key of each band, with the band's number in it: (sets, bands)."""
    out = np.empty((signature.shape[1], bands), np.int64)
    for b in range(bands):
        key = np.full(signature.shape[1], b + 1, np.uint64)
        for r in range(rows):
            key = mix64(key * np.uint64(3) + signature[b * rows + r])
        out[:, b] = key.view(np.int64)
    return out


def _signer(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for part, texts in slices(batch, "text", 1 << 20):
                sets = sets_of(texts, words, size)
                some = [i for i, s in enumerate(sets) if len(s)]
                prints = np.zeros((len(sets), 2), np.int64)
                lists: list[np.ndarray] = [np.zeros(0, np.int64)] * len(sets)
                if some:
                    keys = band_keys(signatures([sets[i] for i in some], bands * rows), bands, rows)
                    for i, k in zip(some, keys, strict=True):
                        lists[i] = k
                        prints[i] = np.frombuffer(xxhash.xxh3_128_digest(sets[i].tobytes()), "<i8")
                n = pa.array([len(s) for s in sets], pa.int64())
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), n, pa.array(prints[:, 0].copy()), pa.array(prints[:, 1].copy()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists)))], ["doc_id", "n_shingles", "f1", "f2", "bands"])

    return run


def _listed(size: int):
    """Texts to their shingles; `print` tells texts of one doc_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for part, texts in slices(batch, "text", 1 << 20):
                sets = sets_of(texts, words, size)
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                prints = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("rep"), part.column("component"), pa.array(prints), pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))], ["rep", "component", "print", "size", "shingles"])

    return run


def rare_pairs(open_texts: DataFrame, percent: int, shingle: int) -> DataFrame:
    """Pairs a < b of different components (rows rep, component, text) that may reach the threshold: those that share one of their rarest shingles.

    A set of n shingles needs ceil(percent n / 100) of them in common with another, so one at least of any n + 1 - that many.
    Shingles are ordered by how many of these texts hold them; those held by one text alone come first, pair with none,
    and bound what a text can have in common with any other.
    """
    rows = open_texts.select("rep", "component", "text").mapInArrow(lean(_listed(shingle)), "rep long, component long, print long, size long, shingles array<long>").where("size > 0")
    flat = rows.select("rep", "component", "print", "size", F.explode("shingles").alias("s"))
    shared = flat.groupBy("s").agg(F.count("*").alias("n")).where("n > 1")
    lists = flat.join(shared, "s").groupBy("rep", "component", "print", "size").agg(F.array_sort(F.collect_list(F.struct("n", "s"))).alias("l"))
    need = lambda n: F.floor((percent * n + 99) / 100)  # noqa: E731  of n in common with a larger set
    need_of_both = lambda n: F.floor((percent * n + 99 + percent) / (100 + percent))  # noqa: E731  in common of two sets with n together
    own = F.col("size") - F.size("l")
    places = F.greatest(F.col("size") + 1 - need(F.col("size")) - own, F.lit(0)).cast("int")
    heads = lists.select("rep", "component", "size", F.size("l").alias("met"), own.alias("own"), F.posexplode(F.slice("l", 1, places)).alias("i", "h"))
    heads = heads.select("rep", "component", "size", "met", "h.s", (F.col("own") + F.col("i") + 1).alias("place"))
    x, y = (heads.select("s", *[F.col(c).alias(f"{side}_{c}") for c in ("rep", "size", "component", "met", "place")]) for side in "xy")
    y = y.where(F.col("y_place") <= F.col("y_size") + 1 - need_of_both(2 * F.col("y_size")))  # the smaller set needs fewer places
    smaller = (F.col("x_size") > F.col("y_size")) | ((F.col("x_size") == F.col("y_size")) & (F.col("x_rep") < F.col("y_rep")))
    needed = need_of_both(F.col("x_size") + F.col("y_size"))
    # at the first shingle in common: no more can be in common than follow it in either, or than either shares with any text
    most = F.least("x_met", "y_met", F.col("x_size") - F.col("x_place") + 1, F.col("y_size") - F.col("y_place") + 1)
    return x.join(y, "s").where(smaller & (F.col("x_component") != F.col("y_component")) & (most >= needed)).select(F.least("x_rep", "y_rep").alias("a"), F.greatest("x_rep", "y_rep").alias("b"))


def _checker(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        last: tuple[int | None, bytes | None, np.ndarray] = (None, None, np.zeros(0, np.uint64))
        for batch in batches:
            link = []
            for a, ta, tb in zip(batch.column("a").to_pylist(), as_bytes(batch.column("text_a")), as_bytes(batch.column("text_b")), strict=True):
                if last[0] != a or last[1] != ta:
                    last = a, ta, sets_of([ta], words, size)[0]
                x, y = last[2], sets_of([tb], words, size)[0]
                both = len(np.intersect1d(x, y, assume_unique=True)) if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) else 0
                link.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            kept_rows = batch.select(["a", "b"]).filter(pa.array(link, pa.bool_()))
            if kept_rows.num_rows:
                yield kept_rows

    return run


def components(links: DataFrame, at: str | None = None) -> DataFrame:
    """doc_id and the smallest doc_id it is connected with, for all that have a link (a, b); a written table."""
    spark = links.sparkSession
    path = scratch(spark, "links")
    edges = kept(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), path)
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        new = scratch(spark, "links")
        edges = kept(small, new)
        discard(spark, path)
        path = new
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    out = kept(edges.select(F.col("u").alias("doc_id"), F.col("v").alias("component")).unionAll(edges.select(F.col("v").alias("doc_id"), F.col("v").alias("component")).distinct()), at or scratch(spark, "components"))
    discard(spark, path)
    return out


def _texts(docs: DataFrame, ids: DataFrame, most_broadcast_ids: int) -> DataFrame:
    few = ids.count() <= most_broadcast_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def near_duplicates(docs: DataFrame, percent: int = 80, shingle: int = 5, bands: int = 32, rows: int = 5, rounds: int = 2, most_broadcast_ids: int = 2_000_000) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id it is linked with, itself included), n_links (links found in its class's rounds), kept."""
    spark = docs.sparkSession
    small_batches(spark)
    signed_at = scratch(spark, "signatures")
    signed = kept(docs.select("doc_id", "text").mapInArrow(lean(_signer(shingle, bands, rows)), SIGNED), signed_at)
    some = signed.where("n_shingles > 0 and doc_id is not null")
    classes_at = scratch(spark, "classes")
    classes = kept(some.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands")), classes_at)
    spread = classes.select("rep", "size", F.explode("bands").alias("key"))
    full = spread.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared_at, members_at = scratch(spark, "shared"), scratch(spark, "buckets")
    shared = kept(spread.join(full, "key"), shared_at)
    members = kept(shared.drop("n").join(shared.groupBy("rep").agg(F.sum("n").alias("degree")), "rep"), members_at)
    discard(spark, shared_at)
    best = lambda what: F.max_by(what, F.struct("degree", -F.col("rep")))
    alike = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)  # noqa: E731  sets of such sizes can be similar enough
    texts_at = scratch(spark, "texts")
    texts = kept(_texts(docs, members.select(F.col("rep").alias("doc_id")).distinct(), most_broadcast_ids), texts_at)

    tested_at: list[str] = []
    links_at: list[str] = []
    shape = "a long, b long"

    def read(paths: list[str]) -> DataFrame:
        return functools.reduce(DataFrame.unionAll, [spark.read.schema(shape).parquet(p) for p in paths]) if paths else spark.createDataFrame([], shape)

    def check(pairs: DataFrame) -> None:
        """Holds new pairs (a < b) against each other; what was tested and what links is written."""
        tested_at.append(scratch(spark, "tested"))
        new = pairs.select("a", "b").distinct()
        if len(tested_at) > 1:
            new = new.join(read(tested_at[:-1]), ["a", "b"], "left_anti")
        new = kept(new, tested_at[-1])
        with_b = new.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        with_both = with_b.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        links_at.append(scratch(spark, "found"))
        kept(with_both.select("a", "b", "text_a", "text_b").mapInArrow(lean(_checker(shingle, percent)), shape), links_at[-1])

    def same_class_links() -> DataFrame:
        """Rows that share a doc_id may lie in several classes."""
        own = some.select("doc_id", "f1", "f2").distinct()
        several = own.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
        return own.join(several, "doc_id", "left_semi").join(classes.select("f1", "f2", "rep"), ["f1", "f2"]).select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))

    twice = same_class_links()
    component_at: list[str] = []
    for turn in range(rounds + 1):
        if turn:
            component_at.append(scratch(spark, "components"))
            component = components(read(links_at), component_at[-1])
            placed = members.join(component.withColumnRenamed("doc_id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
            mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
            open_at = scratch(spark, "open")
            opened = kept(placed.join(mixed, "key"), open_at)
            some_left = bool(opened.head(1))
            if some_left and turn == rounds:
                left = opened.select(F.col("rep").alias("doc_id"), "component").distinct()
                check(rare_pairs(texts.join(left, "doc_id").withColumnRenamed("doc_id", "rep"), percent, shingle))
            elif some_left:
                first = opened.groupBy("key").agg(best(F.col("component")).alias("done"))
                others = opened.join(first, "key").where("component <> done")
                centre = others.groupBy("key").agg(best(F.struct(F.col("rep").alias("c_rep"), F.col("size").alias("c_size"), F.col("component").alias("c_component"))).alias("c")).select("key", "c.*")
                check(opened.join(centre, "key").where((F.col("c_component") != F.col("component")) & alike(F.col("size"), F.col("c_size"))).select(F.least("rep", "c_rep").alias("a"), F.greatest("rep", "c_rep").alias("b")))
            discard(spark, open_at)
            if not some_left:
                break
        else:
            centre = members.groupBy("key").agg(best(F.struct(F.col("rep").alias("c_rep"), F.col("size").alias("c_size"))).alias("c")).select("key", "c.*")
            check(members.join(centre, "key").where((F.col("rep") != F.col("c_rep")) & alike(F.col("size"), F.col("c_size"))).select(F.least("rep", "c_rep").alias("a"), F.greatest("rep", "c_rep").alias("b")))

    found = read(links_at)
    component_at.append(scratch(spark, "components"))
    component = components(found.unionAll(twice), component_at[-1])
    number = found.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    heads_at = scratch(spark, "heads")
    heads = kept(classes.select("f1", "f2", "rep").join(component.withColumnRenamed("doc_id", "rep"), "rep", "left").join(number, "rep", "left").select("f1", "f2", F.coalesce("component", "rep").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")), heads_at)
    discard(spark, members_at, texts_at, classes_at, *tested_at, *links_at, *component_at)
    alone = F.col("n_shingles") == 0
    joined = signed.select("doc_id", "n_shingles", F.when(~alone, F.col("f1")).alias("f1"), F.when(~alone, F.col("f2")).alias("f2")).join(heads, ["f1", "f2"], "left")
    own = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    rows = joined.select("doc_id", "n_shingles", own.cast("long").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))
    out = kept(rows, scratch(spark, "near-duplicates"))
    discard(spark, signed_at, heads_at)
    return out


def keep_one(docs: DataFrame, percent: int = 80, **options: int) -> DataFrame:
    """The documents (all columns) of which one of each component stays, the one with the smallest doc_id; of rows that share that doc_id, all."""
    gone = near_duplicates(docs, percent, **options).where("not kept").select(F.col("doc_id").alias("\0gone")).distinct()
    rows = docs.join(gone, docs["doc_id"].cast("long") == F.col("\0gone"), "left_anti")
    return rows.select(*[docs[c] for c in docs.columns])
