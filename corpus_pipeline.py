"""The corpus pipeline: five stages over ``documents``, each on all that the one before kept.

A stage is a function of (spark, docs, sf_dir); all but the last return the columns of documents.  Every stage takes
any rows: nulls in any column, empty and very long texts, repeated rows and ids, extra columns of any name without a dot (kept as they are), and no rows at all (then it returns none).
What each makes of them its docstring says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, decontam, pii, simhash, toxicity
from tidemark.llm.common import remove, shared_dir, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject.  Null and empty texts hold nothing toxic and stay; repeated rows stay."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies (sets of five-word shingles that overlap by 0.8 or more), the one
    with the smallest id.  Texts without words are copies of each other; rows that repeat an id are too; a group whose ids are
    all null keeps one row for each distinct set."""
    return simhash.deduplicate(docs, simhash.SIMILAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; documents that consist of nothing else go.  Null and empty texts hold no passage and stay."""
    return _sized(decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind.  Null and empty texts stay as they are."""
    return _sized(pii.redact(docs))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids and decoded text as digests.  A null text counts as empty."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.op3(docs, bpe.Tokenizer(spark, path, public_tokenizers.PATTERN))


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.selectExpr(*("cast(length(text) as bigint) as n_chars" if c == "n_chars" else f"`{c}`" for c in docs.columns))


STAGES = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("byte_bpe", byte_bpe),
]

#: Models and fingerprints have no SQL; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's table goes when the next one's stands."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
