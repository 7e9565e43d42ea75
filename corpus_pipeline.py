"""A training-data pipeline: five stages over ``documents``, each over all rows that the one before kept.

Stages 1 to 4 keep the columns of documents, whatever others there are beside doc_id, text and lang; the last one returns
token counts and digests. They hold models and a tokenizer that SQL can't express, so there is no ORACLE_SQL; a brute-force
version in the tests takes its place. Texts are read whole in all stages, whatever their length; an empty table goes through
all of them and stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrafold.llm import bpe, decontaminate, langid, neardup, secrets
from terrafold.llm.common import keep, shared_dir, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: null and empty texts and those without a letter.

    Repeated rows and null ids are judged alike. Without a labelled document nothing can be told, and all go.
    """
    return langid.reject(spark, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that with the smallest id.

    Ids decide: rows with a null id and all rows of a repeated id that stays are kept, as are texts without a word.
    """
    return neardup.first_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go.

    Null and wordless texts hold none and stay; repeated rows and null ids are judged alike.
    """
    return decontaminate.decontaminate(spark, docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by the names of their kinds.

    Null texts stay null; copies of a text are redacted alike; of spans that overlap the first one's name stands.
    """
    return secrets.redacted(docs, shared_dir(spark, "secret-ledger"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left, decoded again; a null text counts as empty, each row gives a row."""
    return bpe.op8(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("secrets", secret_scan), ("encode", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
