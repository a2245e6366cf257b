"""Language ID by rank-order profiles: a text's most frequent n-grams against each language's, by out-of-place distance.

Letters are lower-cased; every run of other characters is one blank, so n-grams (1 to 3 characters) know where
words begin and end. A language's profile is the ranking of its `profile` most frequent n-grams over all its
training texts, counted in Spark. A text's own ranking holds its `profile` most frequent n-grams, counted over
the whole text; ties go to the smaller n-gram code. The distance to a language adds, for each n-gram of the
text, how many places it is off, or `profile` if the language's profile lacks it. The nearest language wins
(ties: the first by name). score = 1 - distance / (profile * n-grams ranked), which is between 0 and 1.

Only text is read for a prediction. Defined cases: text null or without a letter gives `und` and score 0; texts
of other scripts than those learned get the nearest language and a low score; rows without lang or text are not
learned from; if nothing was learned every prediction is `und`. Profiles are `profile` rows per language on the
driver. Rows that share a doc_id are predicted each for itself.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, slices, small_batches

PREDICTED = "doc_id long, lang_pred string, score double"
UNKNOWN = "und"


class Letters:
    """Code point to lower-case letter code, or 0 for all else; a table grown once per worker."""

    def __init__(self) -> None:
        self.table = np.zeros(0x110000, np.uint32)
        self.known = np.zeros(0x110000, bool)

    def codes(self, text: bytes) -> np.ndarray:
        points = np.frombuffer(text.decode().encode("utf-32-le"), np.uint32)
        if len(points) and not self.known[points].all():
            for p in np.unique(points[~self.known[points]]).tolist():
                ch = chr(p)
                low = ch.lower()
                self.table[p] = (ord(low) if len(low) == 1 else p) if unicodedata.category(ch)[0] == "L" else 0
                self.known[p] = True
        return self.table[points]


def grams_of(codes: np.ndarray) -> np.ndarray:
    """Keys of all 1- to 3-grams of the text with blanks merged and one at either end; a lone blank and n-grams with a blank inside are none."""
    c = np.concatenate([[0], codes, [0]]).astype(np.uint64)
    c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]
    if len(c) < 3:
        return np.zeros(0, np.uint64)
    s = np.uint64(21)
    two = c[:-1] << s | c[1:]
    three = (two[:-1] << s | c[2:])[c[1:-1] != 0]
    tag = np.uint64(1) << np.uint64(63)  # a leading blank must not make a 3-gram look like a 2-gram
    return np.concatenate([c[c != 0], two | np.uint64(1) << np.uint64(62), three | tag])


def ranked(grams: np.ndarray, profile: int) -> np.ndarray:
    """The most frequent keys, most frequent first, ties by key."""
    grams = np.sort(grams)
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
    keys, n = grams[first], np.diff(np.append(first, len(grams)))
    if len(keys) > profile:  # only those that can be among the first
        least = np.partition(n, len(n) - profile)[len(n) - profile]
        keys, n = keys[n >= least], n[n >= least]
    return keys[np.argsort(-n, kind="stable")][:profile]


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    letters = Letters()
    held: dict[str, list[np.ndarray]] = {}
    size = 0
    total: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def merge() -> None:
        for lang, parts in held.items():
            keys, n = np.unique(np.concatenate(parts), return_counts=True)
            if lang in total:
                both, inverse = np.unique(np.concatenate([total[lang][0], keys]), return_inverse=True)
                keys, n = both, np.bincount(inverse, weights=np.concatenate([total[lang][1], n])).astype(np.int64)
            total[lang] = keys, n
        held.clear()

    for batch in batches:
        for rows, texts in slices(batch, "text", 2 << 20):
            for lang, text in zip(rows.column("lang").to_pylist(), texts, strict=True):
                if text:
                    held.setdefault(lang, []).append(g := grams_of(letters.codes(text)))
                    size += len(g)
            if size > 4_000_000:
                merge()
                size = 0
            if sum(len(k) for k, _ in total.values()) > 1_000_000:
                for lang, (keys, n) in total.items():
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])
                total.clear()
    merge()
    for lang, (keys, n) in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])


def learn(docs: DataFrame, profile: int = 400) -> dict[str, np.ndarray]:
    """Each language's ranked keys, from columns text and lang; none if there is no column lang."""
    small_batches(docs.sparkSession)
    if "lang" not in docs.columns:
        return {}
    counts = docs.where("lang is not null and text is not null").select("lang", "text").mapInArrow(lean(_counter), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # ranked twice: first among those of one hash, so that no task sorts a whole language
    by_part = Window.partitionBy("lang", "part").orderBy(F.desc("n"), "order")
    by_lang = Window.partitionBy("lang").orderBy(F.desc("n"), "order")
    order = F.when(F.col("gram") < 0, F.lit(1)).otherwise(F.lit(0)).alias("high")  # keys are unsigned
    rows = counts.withColumn("order", F.struct(order, "gram")).withColumn("part", F.pmod(F.hash("gram"), F.lit(32)))
    rows = rows.withColumn("r", F.row_number().over(by_part)).where(F.col("r") <= profile).withColumn("r", F.row_number().over(by_lang)).where(F.col("r") <= profile)
    found: dict[str, list] = {}
    for r in rows.select("lang", "r", "gram").collect():
        found.setdefault(r[0], []).append((r[1], r[2]))
    return {lang: np.array([g for _, g in sorted(v)], np.int64).view(np.uint64) for lang, v in sorted(found.items())}


class Judge:
    def __init__(self, profiles: dict[str, np.ndarray], profile: int) -> None:
        self.names, self.profile, self.letters = sorted(profiles), profile, Letters()
        self.sorted = []
        for name in self.names:
            order = np.argsort(profiles[name], kind="stable")
            self.sorted.append((profiles[name][order], order))

    def __call__(self, texts: list[bytes | None]) -> tuple[list[str], np.ndarray]:
        tops = []
        for text in texts:
            tops.append(ranked(grams_of(self.letters.codes(text)), self.profile) if text else np.zeros(0, np.uint64))
        sizes = np.array([len(t) for t in tops], np.int64)
        keys = np.concatenate(tops) if tops else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(tops)), sizes)
        rank = np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        off = np.full((len(self.names), len(texts)), np.inf)
        for k, (own, ranks) in enumerate(self.sorted):
            at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
            places = np.where(own[at] == keys, np.minimum(np.abs(ranks[at] - rank), self.profile), self.profile)
            off[k] = np.bincount(owner, weights=places, minlength=len(texts))
        if not self.names:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best = off.argmin(axis=0)
        score = 1 - off.min(axis=0) / np.maximum(self.profile * sizes, 1)
        return [self.names[b] if n else UNKNOWN for b, n in zip(best, sizes, strict=True)], np.where(sizes > 0, score, 0.0)


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], profile: int = 400) -> DataFrame:
    """doc_id, lang_pred, score of every document."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(profiles, profile)
        for batch in batches:
            for rows, texts in slices(batch, "text"):
                names, score = judge(texts)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), PREDICTED)


def keep_known(docs: DataFrame, profiles: dict[str, np.ndarray], profile: int = 400, least: float = 0.0) -> DataFrame:
    """The documents (all columns) that get a language and at least that score; the others go. Without any profile: those with a letter."""
    small_batches(docs.sparkSession)
    if not profiles:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(profiles, profile)
        for batch in batches:
            for rows, texts in slices(batch, "text"):
                names, score = judge(texts)
                yield rows.filter(pa.array([n != UNKNOWN and s >= least for n, s in zip(names, score, strict=True)], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
