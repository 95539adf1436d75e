"""The queries of this subpackage and the SQL some of them are checked by."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from graphreports.llm import conversations, decontamination, extraction, fingerprint, linededup, mixing, neural_lm, packing, quality, runs, simhash, toxicity, warc
from graphreports.llm.common import table
from graphreports.runtime import new_folder

WORDS_PATH = public_tokenizers.path("word_bpe_49k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), WORDS_PATH)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.roundtrip(table(spark, sf_dir, "pages"), new_folder(spark, "warc"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.report(table(spark, sf_dir, "documents"))


def op7_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.report(table(spark, sf_dir, "pages"))


def op8_neural_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neural_lm.score(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.report(table(spark, sf_dir, "documents"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.report(table(spark, sf_dir, "conversations"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_packing": op2_packing,
    "op3_warc": op3_warc,
    "op4_mixing": op4_mixing,
    "op5_simhash": op5_simhash,
    "op6_fingerprint": op6_fingerprint,
    "op7_extraction": op7_extraction,
    "op8_neural_lm": op8_neural_lm,
    "op9_line_dedup": op9_line_dedup,
    "op10_quality": op10_quality,
    "op11_runs": op11_runs,
    "op12_conversations": op12_conversations,
    "op13_decontamination": op13_decontamination,
    "pipeline": pipeline,
}
ORACLES: dict[str, str] = {"op4_mixing": mixing.SQL, "op13_decontamination": decontamination.SQL}
