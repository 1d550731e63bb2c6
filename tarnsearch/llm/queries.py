"""Queries of the corpus operators over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnsearch.llm import audio, decontaminate, langid, lm, mixing, neardup, pii, quality, suffixes, tokencount
from tarnsearch.llm._spark import ship, table


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return langid.identified(table(spark, sf_dir, "documents"))


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), tokencount.vocabulary())


def op3_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return audio.text_audio(table(spark, sf_dir, "documents"))


def surrogate_key(spark: SparkSession) -> str:
    """The secret of surrogates, from the session; where it is unset, a public one, so that results can be compared."""
    return spark.conf.get("spark.tarnsearch.surrogate.key", "not a secret")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace(docs, surrogate_key(spark), count_col="n_entities")


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return neardup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return lm.scored(table(spark, sf_dir, "documents"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_language": op1_language,
    "op2_tokens": op2_tokens,
    "op3_audio": op3_audio,
    "op4_pii": op4_pii,
    "op5_neardup": op5_neardup,
    "op6_mix": op6_mix,
    "op7_decontaminate": op7_decontaminate,
    "op8_quality": op8_quality,
    "op9_lm": op9_lm,
    "op10_repeats": op10_repeats,
}

ORACLES = {"op6_mix": mixing.SQL.replace("{docs}", "documents")}
