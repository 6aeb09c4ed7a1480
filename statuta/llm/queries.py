"""The operators over the given tables, with production parameters, each beside the SQL that must give the same rows where SQL can."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from statuta.llm import alignment, bagminhash, decontamination, language, packing, quality, revisits, sentencepieces, sharding, spelling, topk, toxicity, urlrules
from statuta.sources.tables import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_language")
def op1_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.classify(table(spark, folder, "documents"))


@query("op2_packing")
def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op3_revisits", revisits.SQL)
def op3_revisits(spark: SparkSession, folder: str) -> DataFrame:
    return revisits.digest(table(spark, folder, "pages"))


@query("op4_decontamination")
def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"), shortest=1)


@query("op5_topk")
def op5_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.fiftieth(table(spark, folder, "embeddings"))


@query("op6_urlrules", urlrules.SQL)
def op6_urlrules(spark: SparkSession, folder: str) -> DataFrame:
    return urlrules.judge(table(spark, folder, "pages"), spark.createDataFrame(urlrules.RULES, "host string, path string, action string"))


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op8_sharding")
def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assign(table(spark, folder, "documents"))


@query("op9_bagminhash")
def op9_bagminhash(spark: SparkSession, folder: str) -> DataFrame:
    return bagminhash.classes(table(spark, folder, "documents"))


@query("op10_quality")
def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op11_alignment")
def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op12_spelling", spelling.SQL)
def op12_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))


@query("op13_sentencepiece")
def op13_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return sentencepieces.digest(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)
