"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Words are the runs of `[^\\x20\\x09-\\x0D]+`. Every word and every pair of neighbouring words of a text falls,
by a 64-bit hash, into one of `buckets` buckets. Two multinomials are counted: the target over the documents
labelled trusted, the raw one over all documents; the target is smoothed by mixing `raw_share` of the raw one into
it, so an n-gram as frequent in both adds 0 whatever the sizes, and one that no trusted text has adds
log(raw_share). A document's score is the mean over its n-grams of log p_target - log p_raw. It is kept when it passes the base
rules and its score is at least `threshold`: every document is judged by the same numbers.

`learn` sets both from the data. Buckets are the power of two above a quarter of the counted n-grams, within
LEAST_BUCKETS and MOST_BUCKETS. Scores move towards 0 as buckets fill, so the threshold is measured at that number, over all
labelled documents that pass the base rules: the cut is taken that best tells the trusted ones from those labelled quality 0. A trusted
document is scored there by the target without its own n-grams, as if it had been held back; all trusted ones count in the target
that is returned. `fit` takes a given number of buckets.

Base rules: n_words >= 10 and at most 20 in a hundred of its words in repeated 5-word windows.

Plan. One scan counts (blocks of BLOCK buckets reach the shuffle compressed, and their sums the driver), a second one scores the
labelled documents, a third one all. The labelled ids are joined to the documents: broadcast while their
counted number is at most `most_broadcast_ids`, by a shuffle join beyond it. The scores of labelled documents are counted by value and
dealt by range; the driver gets each range's sums only.

Defined cases. Null or empty text: no words, fails the base rules, score null. doc_id null: never trusted. A
document labelled more than once is trusted if all its labels are. No trusted document: all scores are 0, so
the base rules decide alone; as they do when no trusted document passes them. The only trusted document scores 0 without itself. No document
labelled 0 that passes: the threshold is the hundredth part from below of the trusted ones' scores. Rows that share a doc_id are judged each for itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, discard, kept, lean, mix64, release, scratch, slices, small_batches

JUDGED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
#: Buckets that travel as one row.
BLOCK = 1 << 12
#: Bounds of the number of buckets: a worker counts two 64-bit numbers for each of the most.
LEAST_BUCKETS, MOST_BUCKETS = 1 << 16, 1 << 22


class Hashes(dict):
    """Word to 64-bit hash; starts afresh when it holds `most` words."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes], most: int = 200_000) -> np.ndarray:
        if len(self) > most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def split_words(texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray]:
    """All words in order, and each text's number of words."""
    words: list[bytes] = []
    sizes = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if text:
            own = text.split()
            words += own
            sizes[i] = len(own)
    return words, sizes


def features(hashes: np.ndarray, sizes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words and word pairs, and the text that each belongs to."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    same = owner[1:] == owner[:-1] if len(owner) else np.zeros(0, bool)
    pairs = mix64(hashes[:-1] * np.uint64(3) + mix64(hashes[1:]))[same] if len(owner) else hashes
    both = np.concatenate([mix64(hashes), pairs])
    return (both % np.uint64(buckets)).astype(np.int64), np.concatenate([owner, owner[1:][same] if len(owner) else owner])


def repeated_words(hashes: np.ndarray, sizes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each text, its words inside windows that occur twice or more in it. Windows are told apart by 64-bit hashes."""
    n = len(hashes)
    if n < window:
        return np.zeros(len(sizes), np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    key = np.zeros(n - window + 1, np.uint64)
    for k in range(window):
        key = mix64(key * np.uint64(5) + hashes[k : n - window + 1 + k])
    whole = owner[window - 1 :] == owner[: n - window + 1]
    key = mix64(key + owner[: n - window + 1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    at = np.flatnonzero(whole)
    if not len(at):
        return np.zeros(len(sizes), np.int64)
    order = at[np.argsort(key[at], kind="stable")]
    k = key[order]
    same = k[1:] == k[:-1]
    twice = np.zeros(len(k), bool)
    twice[1:] |= same
    twice[:-1] |= same
    begin = order[twice]
    change = np.zeros(n + 1, np.int64)
    change[begin] += 1
    np.add.at(change, begin + window, -1)
    hit = np.cumsum(change[:-1]) > 0
    return np.bincount(owner[hit], minlength=len(sizes)).astype(np.int64)


def plain_counts(text: bytes | None) -> tuple[int, int, int]:
    """Code points in words, symbols, and lines with a word that equal an earlier line."""
    if not text:
        return 0, 0, 0
    bare = text.translate(None, b" \t\n\x0b\x0c\r")
    chars = len(bare) if bare.isascii() else len(bare.decode())
    symbols = len(bare) - len(bare.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return chars, symbols, len(lines) - len(set(lines))


def packed(counts: np.ndarray) -> bytes:
    """Both rows of counts in the narrowest integers that hold them, compressed."""
    return zlib.compress(counts.astype(np.min_scalar_type(counts.max())).tobytes(), 1)


def unpacked(data: bytes, size: int) -> np.ndarray:
    data = zlib.decompress(data)
    return np.frombuffer(data, f"u{len(data) // (2 * size)}").reshape(2, size).astype(np.int64)


def _counter(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        total = np.zeros((2, buckets), np.int64)
        for batch in batches:
            for rows, texts in slices(batch, "text"):
                words, sizes = split_words(texts)
                bucket, owner = features(hashes.of(words), sizes, buckets)
                np.add.at(total[0], bucket, 1)
                trusted = rows.column("trusted").fill_null(False).to_numpy(zero_copy_only=False)
                np.add.at(total[1], bucket[trusted[owner]], 1)
        for at in range(0, buckets, BLOCK):
            part = total[:, at : at + BLOCK]
            if part[0].any():
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([packed(part)])], ["at", "counts"])

    return run


def _merger(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, counts in zip(batch.column("at").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                n = unpacked(counts, min(BLOCK, buckets - at))
                held[at] = held[at] + n if at in held else n
        for at, n in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([packed(n)])], ["at", "counts"])

    return run


def classes(labels: DataFrame) -> DataFrame:
    """doc_id, trusted, junk of each labelled document: whether all its labels say so."""
    good = F.coalesce(F.col("quality") == 1, F.lit(False))
    if "toxic" in labels.columns:
        good &= ~F.coalesce(F.col("toxic") == 1, F.lit(False))
    rows = labels.where("doc_id is not null").select("doc_id", good.alias("trusted"), F.coalesce(F.col("quality") == 0, F.lit(False)).alias("junk"))
    return rows.groupBy("doc_id").agg(F.min("trusted").alias("trusted"), F.min("junk").alias("junk"))


def counted(docs: DataFrame, ids: DataFrame, few: bool, buckets: int) -> np.ndarray:
    """N-grams of each bucket: of all documents, and of those among the ids."""
    ids = ids.select("doc_id", F.lit(True).alias("trusted"))
    rows = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, "doc_id", "left").select("text", "trusted")
    parts = rows.mapInArrow(lean(_counter(buckets)), "at long, counts binary").repartition("at").mapInArrow(lean(_merger(buckets)), "at long, counts binary")
    total = np.zeros((2, buckets), np.int64)
    for r in parts.toLocalIterator():
        total[:, r["at"] : r["at"] + BLOCK] = unpacked(bytes(r["counts"]), min(BLOCK, buckets - r["at"]))
    return total


def log_ratio(total: np.ndarray, raw_share: float) -> np.ndarray:
    raw, target = total.astype(float)
    if not target.sum():
        return np.zeros(len(raw))
    return np.log((1 - raw_share) * (target / target.sum()) / np.where(raw > 0, raw / raw.sum(), 1) + raw_share)


def fit(docs: DataFrame, labels: DataFrame, buckets: int = 1 << 16, raw_share: float = 0.25, most_broadcast_ids: int = 2_000_000) -> np.ndarray:
    """log p_target - log p_raw of each bucket. labels: doc_id and quality (1: trusted), toxic (1: not trusted) if there."""
    small_batches(docs.sparkSession)
    few = labels.where("doc_id is not null").count() <= most_broadcast_ids
    return log_ratio(counted(docs, classes(labels).where("trusted"), few, buckets), raw_share)


def left_out(total: np.ndarray, raw_share: float, bucket: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """Scores of texts that are counted in the target, each by the target without the text itself."""
    buckets = total.shape[1]
    keys, own = np.unique(owner * buckets + bucket, return_counts=True)
    at, text = keys % buckets, keys // buckets
    n = np.bincount(owner, minlength=texts)
    raw_n, target_n = total.sum(axis=1, dtype=np.int64)
    rest = target_n - n
    target = (total[1, at].astype(np.int64) - own) / np.maximum(rest, 1)[text]
    logs = np.log((1 - raw_share) * target / (total[0, at] / raw_n) + raw_share)
    return np.where(rest > 0, np.bincount(text, weights=own * logs, minlength=texts) / np.maximum(n, 1), 0.0)


def labelled_scores(docs: DataFrame, ids: DataFrame, few: bool, total: np.ndarray, ratio: np.ndarray, raw_share: float) -> DataFrame:
    """trusted, score of all documents among the ids (doc_id, trusted) that pass the base rules; trusted ones without their own n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            for rows, texts in slices(batch, "text"):
                words, sizes = split_words(texts)
                own = hashes.of(words)
                passed = (sizes >= 10) & (100 * repeated_words(own, sizes) <= 20 * sizes)
                trusted = rows.column("trusted").to_numpy(zero_copy_only=False)
                bucket, owner = features(own, sizes, len(ratio))
                score = np.bincount(owner, weights=ratio[bucket], minlength=len(sizes)) / np.maximum(np.bincount(owner, minlength=len(sizes)), 1)
                good = (passed & trusted)[owner]
                score = np.where(trusted, left_out(total, raw_share, bucket[good], owner[good], len(sizes)), score)
                yield pa.RecordBatch.from_arrays([pa.array(trusted[passed]), pa.array(score[passed])], ["trusted", "score"])

    ids = ids.select("doc_id", "trusted")
    rows = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, "doc_id")
    return rows.select("text", "trusted").mapInArrow(lean(run), "trusted boolean, score double")


def best_cut(scores: DataFrame) -> float:
    """The score between two neighbours from which on the shares of trusted kept and of others rejected add to most; ties: the lowest.

    Equal scores count as one row, which ranges of scores number: sums of the ranges before, and running sums inside each.
    """
    spark = scores.sparkSession
    counts, ranges = scratch(spark, "scores"), scratch(spark, "score-ranges")
    by_score = kept(scores.groupBy("score").agg(F.count_if("trusted").alias("good"), F.count_if(~F.col("trusted")).alias("junk")), counts)
    rows = kept(by_score.repartitionByRange("score").withColumn("part", F.spark_partition_id()), ranges)
    sums = rows.groupBy("part").agg(F.sum("good").alias("good"), F.sum("junk").alias("junk"), F.max("score").alias("last")).orderBy("part").collect()
    before, good, junk, last = [], 0, 0, None
    for r in sums:
        before.append((r["part"], good, junk, last))
        good, junk, last = good + r["good"], junk + r["junk"], r["last"]
    inside = Window.partitionBy("part").orderBy("score")
    earlier = lambda c: F.col(f"{c}_before") + F.coalesce(F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(F.broadcast(spark.createDataFrame(before, "part int, good_before long, junk_before long, last double")), "part")
    rows = rows.select("score", "good", earlier("good").alias("good_below"), earlier("junk").alias("junk_below"), F.coalesce(F.lag("score").over(inside), "last").alias("below"))
    if not good:
        cut = -np.inf
    elif not junk:
        rank = 0.01 * (good - 1)
        place = lambda k: rows.where((F.col("good_below") <= k) & (F.col("good_below") + F.col("good") > k)).first()["score"]
        low, high = place(int(rank)), place(min(int(rank) + 1, good - 1))
        cut = low + (high - low) * (rank - int(rank))
    else:
        top = rows.orderBy((F.col("junk_below") * good - F.col("good_below") * junk).desc(), "score").first()
        cut = top["score"] if top["below"] is None else (top["below"] + top["score"]) / 2
    discard(spark, counts, ranges)
    return float(cut)


def learn(docs: DataFrame, labels: DataFrame, raw_share: float = 0.25, most_buckets: int = MOST_BUCKETS, most_broadcast_ids: int = 2_000_000) -> tuple[np.ndarray, float]:
    """The ratio, over as many buckets as the counted n-grams ask for, and the threshold that all labelled documents give."""
    small_batches(docs.sparkSession)
    ids = classes(labels).where("trusted or junk")
    n = ids.agg(F.count_if("trusted").alias("good"), F.count("*").alias("all")).first()
    total = counted(docs, ids.where("trusted"), n["good"] <= most_broadcast_ids, most_buckets)
    buckets = min(most_buckets, max(LEAST_BUCKETS, 1 << int(total[0].sum() // 4).bit_length()))
    total = total.reshape(2, -1, buckets).sum(axis=1)
    ratio = log_ratio(total, raw_share).astype(np.float32)
    total = total.astype(np.min_scalar_type(total.max()))
    release(docs.sparkSession)
    return ratio, best_cut(labelled_scores(docs, ids, n["all"] <= most_broadcast_ids, total, ratio, raw_share))


def judge(docs: DataFrame, ratio: np.ndarray, threshold: float = -0.3) -> DataFrame:
    """A row per document: the base counts, whether the base rules fail it, its score and whether it is kept."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, names = Hashes(), [f.split()[0] for f in JUDGED.split(", ")]
        for batch in batches:
            for rows, texts in slices(batch, "text"):
                words, sizes = split_words(texts)
                own = hashes.of(words)
                bucket, owner = features(own, sizes, len(ratio))
                n = np.bincount(owner, minlength=len(sizes))
                score = np.bincount(owner, weights=ratio[bucket], minlength=len(sizes)) / np.maximum(n, 1)
                repeats = repeated_words(own, sizes)
                failed = (sizes < 10) | (100 * repeats > 20 * sizes)
                plain = np.array([plain_counts(t) for t in texts], np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array(sizes), *(pa.array(plain[:, k]) for k in range(3)), pa.array(repeats), pa.array(failed), pa.array(score, mask=n == 0), pa.array(~failed & (score >= threshold))], names)

    return docs.select("doc_id", "text").mapInArrow(lean(run), JUDGED)


__all__ = ["Hashes", "as_bytes", "best_cut", "features", "fit", "judge", "labelled_scores", "learn", "left_out", "plain_counts", "repeated_words", "split_words"]
