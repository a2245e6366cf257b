"""The thin queries: each applies one operator to its whole table and derives the columns of its result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, kneser_ney, langid, licenses, line_dedup, minhash, packing, quality, rans, suffix_dedup
from .common import discard, documents, kept, scratch, table


def remainder(divisor: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the doc_id's text, modulo; null ids give null."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % divisor


def held_out(divisor: int) -> Column:
    return F.coalesce(remainder(divisor) == 1, F.lit(False))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.scan(documents(spark, sf_dir), spark.read.parquet(table(sf_dir, "benchmark")))
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op2_rans_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "rans")
    rans.write_ids(documents(spark, sf_dir), path)
    rows = rans.read_ids(spark, path)
    discard(spark, path)  # all that the rows need has been read
    return rows


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.judge(docs, *quality.learn(docs, spark.read.parquet(table(sf_dir, "labels"))))


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = kneser_ney.train(docs.where(~held_out(5)))
    rows = kept(kneser_ney.score(docs, model), scratch(spark, "scores"))
    kneser_ney.remove(spark, model)
    return rows.select("doc_id", held_out(5).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.remove_repeats(documents(spark, sf_dir))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir), licenses.known_licenses(spark))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.drop_repeated_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    profiles = langid.learn(docs.where(~held_out(3)))
    return langid.predict(docs, profiles).select("doc_id", held_out(3).alias("held_out"), "lang_pred", "score")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_rans_ids, op3_quality, op4_kneser_ney, op5_suffix_dedup, op6_licenses, op7_line_dedup, op8_minhash, op9_langid, op10_packing)}
