"""From raw documents to packed training sequences: five stages, each one operator of tessera.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import table, written
from tessera.llm.decontaminate import drop_contaminated
from tessera.llm.langid import drop_unidentified
from tessera.llm.line_templates import drop_recurring
from tessera.llm.near_simhash import drop_near_duplicates
from tessera.llm.packing import pack


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: null or letterless texts, and mixtures without a main language."""
    return drop_unidentified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose template recurs in ten or more different texts go; n_chars, if there, follows a text that was cut. No document goes.

    A null text stays null, an empty one empty; a text whose lines all go becomes empty. Rows with one doc_id, or none, are cut each by its own
    text; repeated rows stay. Other columns pass through.
    """
    return drop_recurring(docs, "n_chars")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, the one with the smallest doc_id; every run keeps the same one.

    Texts without words, null ones too, are alike. Different texts under one doc_id, or under none, are judged each by itself; of repeated rows
    one stays. Other columns pass through.
    """
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark contaminates go. Null and wordless texts, and all where the benchmark is empty, stay; repeated rows are
    judged alike, and other columns pass through.
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, tokenised and packed into sequences of 1024 ids. A null text counts as empty; repeated rows are packed each."""
    return pack(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("simhash_near_dedup", simhash_near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: Language ID, fingerprints and tokens can't be told in SQL; the tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
