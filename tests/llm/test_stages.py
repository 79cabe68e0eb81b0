"""The pipeline's stages on nulls, blanks, long texts, ties, repeated rows, clashing columns and empty tables."""

from __future__ import annotations

from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pitframe.llm import common
from tests.llm.test_edges import clashing, docs, labels, language, quality  # noqa: F401

STAGES = dict(corpus_pipeline.STAGES)
FILTERS = [n for n in STAGES if n != "best-fit packing"]


@pytest.fixture(scope="module")
def sf(labels, tmp_path_factory):  # noqa: F811
    path = tmp_path_factory.mktemp("stages")
    labels.write.parquet(f"{path}/labels.parquet")
    return str(path)


def ids(df) -> Counter:
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


@pytest.mark.parametrize("name", STAGES)
def test_empty_table(spark, docs, sf, name):  # noqa: F811
    got = STAGES[name](spark, docs.limit(0), sf)
    assert got.count() == 0
    if name in FILTERS:
        assert got.schema == docs.schema


@pytest.mark.parametrize("name", FILTERS)
def test_rows_come_out_as_they_went_in(spark, docs, sf, name):  # noqa: F811
    """Other columns, whatever their names, change nothing; what stays is whole."""
    got = STAGES[name](spark, docs, sf)
    assert got.columns == list(corpus_pipeline.COLUMNS)
    rows = lambda df: Counter(map(tuple, df.collect()))
    kept = rows(got)
    assert kept and not kept - rows(docs)
    assert kept == rows(STAGES[name](spark, clashing(docs), sf))


def test_quality_stage_keeps_what_the_operator_keeps(spark, docs, labels, sf):  # noqa: F811
    got = ids(STAGES["quality classifier"](spark, docs, sf))
    assert got == ids(quality(docs, labels).where("kept"))
    assert not got.keys() & {100, 101}  # without a text


def test_language_stage_keeps_what_is_not_rejected(spark, docs, labels, sf):  # noqa: F811
    got = ids(STAGES["language ID"](spark, docs, sf))
    assert got == ids(language(docs, labels).where("not rejected"))
    assert not got.keys() & {100, 101, 102, 103}  # without a letter


def test_near_duplicate_stage_keeps_one_of_each_group(spark, docs, sf):  # noqa: F811
    got = ids(STAGES["n-gram Jaccard join"](spark, docs, sf))
    assert got[None] == 1  # a row without an id is nobody's copy
    assert got[3] == 1 and got[104] == 0  # copies: the smallest id stays
    assert got[106] == 1  # a repeated row stays once
    assert {100, 101, 102} <= got.keys()  # texts without words have no copies
    again = STAGES["n-gram Jaccard join"](spark, docs.where("doc_id is not null and doc_id not in (106)"), sf)
    assert not ids(again) - got


def test_packing_stage_loses_no_token(spark, docs, sf):  # noqa: F811
    got = STAGES["best-fit packing"](spark, docs, sf)
    want = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0]
    assert got.agg(F.sum("n_tokens")).first()[0] == want
    assert got.where("n_tokens > capacity").count() == 0


@pytest.mark.parametrize("name", STAGES)
def test_python_gets_bounded_batches(spark, docs, sf, name):  # noqa: F811
    """However many rows and bytes a task has, a batch has few (before: all 3,000 rows, and 30 MB)."""
    keys = [f"spark.sql.execution.arrow.max{x}PerBatch" for x in ("Records", "Bytes")]
    before = [spark.conf.get(key) for key in keys]
    for key in keys:
        spark.conf.unset(key)

    def sizes(parts):
        for part in parts:
            yield pd.DataFrame({"n": [len(part)], "size": [int(part["text"].str.len().sum())]})

    seen = lambda rows: rows.mapInPandas(sizes, "n long, size long").agg(F.max("n"), F.max("size"), F.sum("n")).first()
    try:
        STAGES[name](spark, docs.limit(0), sf)
        short = seen(spark.range(0, 3_000, 1, 1).select(F.lit("x").alias("text")))
        assert short[0] <= common.BATCH_ROWS and short[2] == 3_000
        long = seen(spark.range(0, 300, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("text")))
        assert long[1] <= common.BATCH_BYTES + 200_000 and long[2] == 300
        spark.conf.set(keys[0], "10")
        spark.conf.set(keys[1], "1m")
        STAGES[name](spark, docs.limit(0), sf)
        assert [spark.conf.get(key) for key in keys] == ["10", "1m"]  # smaller limits of the session stay
    finally:
        for key, value in zip(keys, before):
            spark.conf.set(key, value)
