"""The registered queries of the training-data operators: each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, cotrain, crosstok, decontam, htmltext, lzprint, ngramlm, pii, repetition, simhash, tokenfiles, toxicity, turnrepair
from tidemark.llm.common import table


def op1_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramlm.op1(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.op2(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.op3(table(spark, sf_dir, "documents"), bpe.Tokenizer(spark, path, public_tokenizers.PATTERN))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op4(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lzprint.op5(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op6(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.op7(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op8(table(spark, sf_dir, "documents"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.op9(table(spark, sf_dir, "pages"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.op10(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turnrepair.op11(table(spark, sf_dir, "conversations"))


def op12_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.op12(table(spark, sf_dir, "documents"))


def op13_cross_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return crosstok.op13(table(spark, sf_dir, "documents"), crosstok.Tokenizers(spark, a, b))


QUERIES = {
    "op1_stupid_backoff": op1_stupid_backoff,
    "op2_decontaminate": op2_decontaminate,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_toxicity": op4_toxicity,
    "op5_lz_fingerprint": op5_lz_fingerprint,
    "op6_pii": op6_pii,
    "op7_quality": op7_quality,
    "op8_simhash": op8_simhash,
    "op9_main_text": op9_main_text,
    "op10_token_files": op10_token_files,
    "op11_turn_repair": op11_turn_repair,
    "op12_repetition": op12_repetition,
    "op13_cross_tokens": op13_cross_tokens,
}
ORACLE_SQL = {"op1_stupid_backoff": ngramlm.SQL, "op2_decontaminate": decontam.SQL}
