"""The registered queries of this subpackage: each applies an operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cropspark.llm import language, license, nbsvm, negatives, vafile
from cropspark.llm.common import table
from cropspark.llm.covertree import linked_vectors
from cropspark.llm.decontaminate import contaminated
from cropspark.llm.huffman import encoded_ids
from cropspark.llm.jaccard import similar_documents
from cropspark.llm.packing import pack
from cropspark.llm.pii import find
from cropspark.llm.sharding import byte_shards
from cropspark.llm.urls import ORACLE_SQL as URL_SQL
from cropspark.llm.urls import judge_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_weak_supervision_pii(spark: SparkSession, sf: str) -> DataFrame:
    """Personal data in every document."""
    return find(table(spark, sf, "documents"))


@query
def op2_ecoc_language(spark: SparkSession, sf: str) -> DataFrame:
    """Language of every document by error-correcting output codes."""
    return language.predict(table(spark, sf, "documents"))


@query
def op3_huffman_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of every document, written as Huffman blocks and read back."""
    return encoded_ids(table(spark, sf, "documents")).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op4_license_templates(spark: SparkSession, sf: str) -> DataFrame:
    """License statements of every document."""
    return license.scan(table(spark, sf, "documents"))


@query
def op5_byte_shards(spark: SparkSession, sf: str) -> DataFrame:
    """Sixteen contiguous shards of near-equal bytes."""
    return byte_shards(table(spark, sf, "documents"), 16)


@query
def op6_cover_tree_links(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors linked by a cosine of at least 0.9, and their components."""
    return linked_vectors(table(spark, sf, "embeddings"), 0.9)


@query
def op7_bloom_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Verdict on the url of every page."""
    return judge_urls(table(spark, sf, "pages"))


ORACLE["op7_bloom_cascade"] = URL_SQL


@query
def op8_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    """All documents in sequences of 1024 tokens."""
    return pack(table(spark, sf, "documents"), 1024)


@query
def op9_token_group_join(spark: SparkSession, sf: str) -> DataFrame:
    """Components of documents whose 3-word shingles have a Jaccard similarity of 0.9."""
    return similar_documents(table(spark, sf, "documents"), 3, 90)


@query
def op10_string_tiling(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and the benchmark items they hold."""
    return contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op11_va_file_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Forty exact integer clusters of the vectors after five rounds."""
    return vafile.clustered(table(spark, sf, "embeddings"), 40, 5, 64)


ORACLE["op11_va_file_clusters"] = vafile.oracle(40, 5, 64)


@query
def op12_nb_svm_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Quality of every document, learned from the labels of the training split."""
    return nbsvm.predict(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op13_one_bit_negatives(spark: SparkSession, sf: str) -> DataFrame:
    """Hard negatives of every fiftieth vector's positives."""
    return negatives.hard_negatives(table(spark, sf, "embeddings"))


ORACLE["op13_one_bit_negatives"] = negatives.ORACLE_SQL
