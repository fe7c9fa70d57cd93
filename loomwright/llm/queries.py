"""The queries over this folder's operators, as they are registered in __spark_entry__.py."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, codes, decontam, flac, hardneg, html_text, langid, maxent, neardup, pii, quality, warc
from .common import table

#: For the queries over invented texts only, where the session has no key of its own.
DEMONSTRATION_KEY = "a key that everyone knows"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.surrogates(docs, spark.conf.get(pii.KEY_SETTING, DEMONSTRATION_KEY))


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.scored(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(spark, sf_dir)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.conversations(table(spark, sf_dir, "conversations"), RANKS).drop("n_tokens")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), RANKS)


def op10_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.features(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_near_dedup, op2_html_text, op3_pii_surrogates, op4_lm_scores, op5_language_id, op6_warc, op7_chat_format, op8_decontamination, op9_byte_bpe, op10_flac_media)
} | {f.__name__: f for f in (codes.op11_vector_codes, hardneg.op12_hard_negatives, quality.op13_quality)}
#: The others' digests come from learned models, tokenizers and codecs, or from regular expressions with lookarounds,
#: which DuckDB's SQL does not have; they are tested against brute force in tests/llm.
ORACLES: dict[str, str] = {"op6_warc": warc.ORACLE_SQL, "op7_chat_format": chat.ORACLE_SQL, "op11_vector_codes": codes.ORACLE_SQL, "op12_hard_negatives": hardneg.ORACLE_SQL}
