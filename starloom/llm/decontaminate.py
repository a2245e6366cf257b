"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, one scan of every text.

Words are the runs of bytes `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased. All
separators are ASCII, so the text's UTF-8 bytes can be normalised by one byte table that keeps every offset:
the words of the normalised text stand where they stand in the original. Windows of `window` words (an item
of fewer, but not none, is one window) become patterns with a blank at either end, so a match begins and ends
at words. A document word inside any match is hit.

Size of the automaton: the items' text is measured, and bounds that of their windows; the windows are dealt by hash into
as many automata as keep each below `most_pattern_bytes`, one as a rule. Each is built once, by one task, and stored in the
shared folder; a worker loads it when it first needs it. With several, documents are scanned once for each, and the
hits of the scans are united per document; no window is ever left out.

Defined cases. Null or empty text: no words, no hits. Items without words: no windows. Repeated items with one
item_id: their windows are united. Rows that share a doc_id are scanned each for itself by `scan`; `scan` keeps one
row per input row. An empty benchmark: nothing is hit. Only doc_id and text (item_id and text) are read; other
columns are not touched.
"""

from __future__ import annotations

import functools
import hashlib
import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import mapped, save
from .common import as_bytes, by_shard, kept, lean, scratch, slices, small_batches

#: Every byte that is no word byte becomes a blank; A-Z become a-z; bytes from x80 on are parts of words.
NORMAL = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))

SCANNED = "doc_id long, n_words long, n_hit long, items array<string>, span_starts array<long>, span_ends array<long>"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(NORMAL).split() if text else []


def windows_of(items: list[tuple[object, bytes | None]], window: int) -> dict[bytes, list[str]]:
    """Each window's words joined by blanks, and the sorted ids of the items that hold it."""
    found: dict[bytes, set[str]] = defaultdict(set)
    for item, text in items:
        words = words_of(text)
        for at in range(max(1, len(words) - window + 1) if words else 0):
            found[b" ".join(words[at : at + window])].add(str(item))
    return {w: sorted(ids) for w, ids in found.items()}


def automaton(windows: dict[bytes, list[str]]):
    """The automaton over ` window ` as Latin-1 text (a byte is a character); values: length in bytes between the blanks, and item ids."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for w, ids in windows.items():
        a.add_word(f" {w.decode('latin-1')} ", (len(w), ids))
    if windows:
        a.make_automaton()
    return a


def char_offsets(text: bytes, at: np.ndarray) -> np.ndarray:
    """Byte offsets of a UTF-8 text as offsets in code points."""
    if text.isascii() or not len(at):
        return at
    lead = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    return np.concatenate([[0], np.cumsum(lead)])[at]


def scan_text(text: bytes | None, auto) -> tuple[int, int, list[str], np.ndarray, np.ndarray]:
    """Words, hit words, items, and the runs of hit words as code point offsets (start, end) of the original text."""
    none = np.zeros(0, np.int64)
    if not text:
        return 0, 0, [], none, none
    normal = text.translate(NORMAL)
    words = normal.split()
    if not words or not len(auto):
        return len(words), 0, [], none, none
    found = list(auto.iter(f" {b' '.join(words).decode('latin-1')} "))
    if not found:
        return len(words), 0, [], none, none
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes + 1) - sizes  # in the joined text, which begins with a blank
    ends = np.array([e for e, _ in found], np.int64)
    first = np.searchsorted(starts, ends - np.array([n for _, (n, _) in found], np.int64))
    last = np.searchsorted(starts, ends)  # words that begin before the closing blank
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, last, -1)
    hit = np.cumsum(change[:-1]) > 0
    blank = np.frombuffer(normal, np.uint8) == 32
    begins = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    stops = np.flatnonzero(~blank & np.concatenate([blank[1:], [True]])) + 1
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    spans = char_offsets(text, begins[np.flatnonzero(edge == 1)]), char_offsets(text, stops[np.flatnonzero(edge == -1) - 1])
    return len(words), int(hit.sum()), sorted({i for _, (_, ids) in found for i in ids}), *spans


def _dealer(window: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in slices(batch, "text"):
                for item, text in zip(rows.column("item_id").to_pylist(), texts, strict=True):
                    found = list(windows_of([(item, text)], window))
                    part = [int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "big") % parts for w in found]
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(found, pa.binary()), pa.array([str(item)] * len(found), pa.string())], ["part", "window", "item"])

    return run


def _builder(folder: str):
    def run(key: tuple[int, ...], group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: dict[bytes, set[str]] = defaultdict(set)
        for batch in group:
            for w, item in zip(batch.column("window").to_pylist(), batch.column("item").to_pylist(), strict=True):
                windows[w].add(item)
        made = pickle.dumps(automaton({w: sorted(items) for w, items in windows.items()}))
        save(folder, f"automaton.{key[0]}", np.frombuffer(made, np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([len(windows)], pa.int64())], ["n"])

    return run


def build(benchmark: DataFrame, window: int, most_pattern_bytes: int) -> tuple[str, int]:
    """The automata of a benchmark, as files: their folder and number. An item's windows have at most window + 1 times its text."""
    spark = benchmark.sparkSession
    small_batches(spark)
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size * (window + 1) // most_pattern_bytes))
    folder = scratch(spark, "automata")
    items = benchmark.where("text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    by_shard(items.mapInArrow(lean(_dealer(window, parts)), "part int, window binary, item string"), parts, _builder(folder), "n long", "part").agg(F.sum("n")).collect()
    return folder, parts


@functools.lru_cache(maxsize=1)
def loaded(folder: str, part: int):
    """The automaton, kept by the worker between its tasks; one without words if there are no windows."""
    made = mapped(folder, f"automaton.{part}", "u1", {})
    return pickle.loads(made.tobytes()) if len(made) else automaton({})


def _scanner(folder: str, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = loaded(folder, at)
        for batch in batches:
            for part, texts in slices(batch, "text"):
                rows = [scan_text(t, auto) for t in texts]
                key = [part.column("key")] if "key" in part.schema.names else []
                yield pa.RecordBatch.from_arrays(
                    [*key, part.column("doc_id").cast(pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.string())), *(pa.array([r[k] for r in rows], pa.list_(pa.int64())) for k in (3, 4))],
                    [*(["key"] if key else []), "doc_id", "n_words", "n_hit", "items", "span_starts", "span_ends"],
                )

    return run


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 10, most_pattern_bytes: int = 64 << 20) -> DataFrame:
    """One row per document: words, hit words, the items with matching windows, and the spans of hit words in the original text.

    With more windows than one automaton may hold, hit words of several scans can overlap; their spans are
    then united (words between two spans that touch count once). Scans meet by doc_id and a 128-bit hash of the text.
    """
    small_batches(docs.sparkSession)
    folder, parts = build(benchmark, window, most_pattern_bytes)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if parts == 1:
        return rows.mapInArrow(lean(_scanner(folder, 0)), SCANNED)
    rows = rows.withColumn("key", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    scans = functools.reduce(DataFrame.unionAll, [rows.mapInArrow(lean(_scanner(folder, k)), f"key string, {SCANNED}") for k in range(parts)])
    merged = scans.groupBy("doc_id", "key").agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list(F.arrays_zip("span_starts", "span_ends"))).alias("spans"))
    both = rows.alias("r").join(merged.alias("m"), F.expr("r.doc_id <=> m.doc_id and r.key = m.key"), "left").select("r.doc_id", "r.text", "m.n_words", "m.items", "m.spans")
    return both.mapInArrow(lean(_uniter), SCANNED)


def _uniter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = as_bytes(batch.column("text"))
        out = []
        for text, spans in zip(texts, batch.column("spans").to_pylist(), strict=True):
            text = text or b""
            normal = np.frombuffer(text.translate(NORMAL), np.uint8) == 32
            chars = char_offsets(text, np.arange(len(text)))
            cover = np.zeros(len(text) + 1, bool)
            for s in spans or []:
                cover[np.searchsorted(chars, s["span_starts"]) : np.searchsorted(chars, s["span_ends"])] = True
            begins = np.flatnonzero(~normal & np.concatenate([[True], normal[:-1]])) if len(text) else np.zeros(0, np.int64)
            stops = np.flatnonzero(~normal & np.concatenate([normal[1:], [True]])) + 1 if len(text) else begins
            hit = cover[begins]
            edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
            out.append((int(hit.sum()), char_offsets(text, begins[np.flatnonzero(edge == 1)]), char_offsets(text, stops[np.flatnonzero(edge == -1) - 1])))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array([o[0] for o in out], pa.int64()), batch.column("items"), pa.array([o[1] for o in out], pa.list_(pa.int64())), pa.array([o[2] for o in out], pa.list_(pa.int64()))], ["doc_id", "n_words", "n_hit", "items", "span_starts", "span_ends"])


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, most_pattern_bytes: int = 64 << 20) -> DataFrame:
    """The documents without a hit word, with all their columns. A document (row) with any goes; null and empty texts stay."""
    spark = docs.sparkSession
    small_batches(spark)
    folder, parts = build(benchmark, window, most_pattern_bytes)
    for k in range(parts):
        if k:  # one automaton at a time in a worker
            docs = kept(docs, scratch(spark, "clean"))

        def run(batches: Iterator[pa.RecordBatch], k=k) -> Iterator[pa.RecordBatch]:
            auto = loaded(folder, k)
            for batch in batches:
                clean = []
                for t in as_bytes(batch.column("text")):
                    words = words_of(t)
                    clean.append(not words or not len(auto) or next(auto.iter(f" {b' '.join(words).decode('latin-1')} "), None) is None)
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(lean(run), docs.schema)
    return docs
