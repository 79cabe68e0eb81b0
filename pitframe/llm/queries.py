"""The queries of this subpackage: each applies an operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitframe.llm.common import scratch, table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pitframe.llm.quality import quality

    docs = table(spark, sf_dir, "documents")
    return quality(docs, table(spark, sf_dir, "labels"), F.col("source"), F.concat_ws("/", "source", "lang"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from pitframe.llm.bpe import digests

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pitframe.llm.langid import fit_language, held_out, predict_language

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = held_out(F.col("doc_id"))
    model = fit_language(docs.where(~out))
    return predict_language(docs.select("doc_id", "text", out.alias("held_out")), model).drop("text")


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pitframe.llm.embeddings import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op5_mpegts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pitframe.llm.mpegts import probe, store

    path = scratch(spark, "media")
    store(table(spark, sf_dir, "documents")).write.option("compression", "zstd").parquet(path)
    return probe(spark.read.parquet(path)).drop("timeline")


def op6_bitpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from pitframe.llm.bitpack import read_documents, write_ids

    path = scratch(spark, "token-ids")
    write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 50_257, 0, path)
    return read_documents(spark, path)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pitframe.llm.toxicity import fit_toxicity, grade

    docs = table(spark, sf_dir, "documents")
    return grade(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pitframe.llm.packing import byte_tokens, pack

    return pack(byte_tokens(table(spark, sf_dir, "documents")))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pitframe.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pitframe.llm.urls import judge

    return judge(table(spark, sf_dir, "pages"))


def op11_treebpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from pitframe.llm.treebpe import digests

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pitframe.llm.repair import conversations

    return conversations(table(spark, sf_dir, "conversations"))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pitframe.llm.skiplist import digests

    return digests(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_bpe": op2_bpe,
    "op3_langid": op3_langid,
    "op4_neardup": op4_neardup,
    "op5_mpegts": op5_mpegts,
    "op6_bitpack": op6_bitpack,
    "op7_toxicity": op7_toxicity,
    "op8_packing": op8_packing,
    "op9_minhash": op9_minhash,
    "op10_urls": op10_urls,
    "op11_treebpe": op11_treebpe,
    "op12_repair": op12_repair,
    "op13_fim": op13_fim,
    "pipeline": pipeline,
}
ORACLES: dict[str, str] = {}
