"""A training corpus from `documents`: five stages, each an operator of arborlens.llm, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arborlens.llm import decontam, mixing, quality, secrets, simhash
from arborlens.llm.work import materialize, table

#: No SQL: the quality, near-duplicate and secret stages hold trained models and bitwise comparisons. Tests compare
#: each stage with a brute-force version instead.
ORACLE_SQL = None


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text the classifier scores at least 0.3; null texts and texts without words score as such texts do,
    and equal texts stay or go together."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the smallest doc_id; rows without
    doc_id stay, of rows equal in doc_id and text one."""
    return simhash.simhash_dedup(docs)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; rows without text stay."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def _secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by [SECRET] and n_chars by the new length; null texts stay null."""
    return secrets.redact(docs)


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, with the number of times that it takes each; those that it does not take, and
    those without words, are left out. Rows equal in doc_id, source and size are taken alike."""
    return mixing.mixed(docs)


STAGES = [
    ("quality", _quality),
    ("near_duplicates", _near_duplicates),
    ("decontamination", _decontamination),
    ("secrets", _secrets),
    ("mixing", _mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
