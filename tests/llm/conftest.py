from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(texts, first=0):
    return [(first + i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts, numbered from 0; or from whole rows."""

    def build(items, schema=SCHEMA):
        items = list(items)
        return spark.createDataFrame(items if items and isinstance(items[0], tuple) else rows(items), schema).repartition(3)

    return build


@pytest.fixture(scope="session")
def stored(spark, make, tmp_path_factory):
    """A folder with the tables that queries read."""

    def build(texts, benchmark=(), labels=()):
        at = str(tmp_path_factory.mktemp("tables"))
        make(texts).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        return at

    return build


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}
