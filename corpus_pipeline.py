"""From raw documents to packed training sequences, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the
stage before it kept; its result is written as Parquet and read again as the
next one's ``docs``.  All but the last return the columns of ``documents``.
A stage bounds what its session hands to Python at once
(:func:`~pitframe.llm.common.small_batches`), as all stages share the executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitframe.llm.common import scratch, small_batches, table
from pitframe.llm.langid import fit_language, held_out, predict_language
from pitframe.llm.minhash import keep_one
from pitframe.llm.packing import byte_tokens, pack
from pitframe.llm.quality import keep_quality

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hierarchical empirical Bayes finds good.

    A null or empty text goes; null ids have no label and are judged by text
    and site; repeated rows are judged alike and all stay or go.  Whole texts
    are read, however long.  Columns other than those of ``documents`` go; an
    empty table, or one without labels, is judged as :func:`quality` says.
    """
    small_batches(spark)
    labels = table(spark, sf_dir, "labels")
    return keep_quality(docs.select(*COLUMNS), labels, F.col("source"), F.concat_ws("/", "source", "lang"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within reach of a learned language.

    A text that is null or has no letter goes; null ids are judged, and teach,
    like others; repeated rows stay or go together, and of equally near
    languages the first by name counts.  Where no row has a language, all go.
    """
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    model = fit_language(docs.where(~held_out(F.col("doc_id"))))
    return predict_language(docs, model).where("not rejected").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest doc_id.

    Rows with a null doc_id stay, and so do texts without words, which are
    nobody's copies; a row that comes again stays once.  An empty table stays
    empty.
    """
    small_batches(spark)
    return keep_one(docs.select(*COLUMNS)).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' byte tokens packed into sequences of permitted lengths.

    A null text is an empty one, whose end mark is packed; long texts are cut
    into pieces; repeated rows and null ids are packed as often as they come.
    An empty table gives no bins.
    """
    small_batches(spark)
    return pack(byte_tokens(docs.select(*COLUMNS)))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("best-fit packing", packing_stage),
]

#: No stage can be said in SQL: each learns from, or searches, the whole input.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages on ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(path := scratch(spark, f"stage{i}"))
            docs = spark.read.parquet(path)
    return docs
