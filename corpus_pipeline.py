"""From documents to packed training sequences.

Five stages, each an operator of ``cropspark.llm``; each is written and read again before the next begins. All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cropspark.llm.common import table, written
from cropspark.llm.decontaminate import without_benchmark
from cropspark.llm.jaccard import one_of_each
from cropspark.llm.language import fit, known_language
from cropspark.llm.packing import pack
from cropspark.llm.pii import redact


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is certain."""
    return known_language(docs, fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group with a Jaccard similarity of 0.8 on shingles of five words."""
    return one_of_each(docs, 5, 80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that hold no benchmark item."""
    return without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the documents' tokens into sequences of 1024."""
    return pack(docs, 1024)


STAGES = [
    ("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("personal_data", personal_data), ("packing", packing)]

#: Token ids, components and learned models are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
