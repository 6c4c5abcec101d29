"""The registered queries of this folder, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loreloom.llm.alignment import alignment_digests
from loreloom.llm.bm25 import contaminated
from loreloom.llm.chaining import repeated_passages
from loreloom.llm.common import table
from loreloom.llm.fixity import ORACLE as FIXITY_ORACLE
from loreloom.llm.fixity import audit_pages
from loreloom.llm.langid import predict_languages
from loreloom.llm.packing import pack_documents
from loreloom.llm.pseudonyms import pseudonymised_documents
from loreloom.llm.sharding import shard_documents
from loreloom.llm.simhash import near_duplicates
from loreloom.llm.token_files import token_digests
from loreloom.llm.url_cascade import ORACLE as URL_ORACLE
from loreloom.llm.url_cascade import judge_pages
from loreloom.llm.weighted_sampling import fingerprint_documents
from loreloom.llm.whitening import whitened


def op1_collinear_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op2_byte_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(table(spark, sf_dir, "documents"))


def op3_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised_documents(table(spark, sf_dir, "documents"))


def op4_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_pages(table(spark, sf_dir, "pages"))


def op5_bm25_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_hypergeometric_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op7_grouping_ga(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op8_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_pages(table(spark, sf_dir, "pages"))


def op9_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op10_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op11_feast_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))


def op12_shared_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_digests(table(spark, sf_dir, "documents"))


def op13_huffman_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_collinear_chaining": op1_collinear_chaining,
    "op2_byte_gru": op2_byte_gru,
    "op3_feistel_pseudonyms": op3_feistel_pseudonyms,
    "op4_bloom_cascade": op4_bloom_cascade,
    "op5_bm25_wand": op5_bm25_wand,
    "op6_hypergeometric_shuffle": op6_hypergeometric_shuffle,
    "op7_grouping_ga": op7_grouping_ga,
    "op8_merkle_audit": op8_merkle_audit,
    "op9_simhash_trie": op9_simhash_trie,
    "op10_weighted_sampling": op10_weighted_sampling,
    "op11_feast_whitening": op11_feast_whitening,
    "op12_shared_cuts": op12_shared_cuts,
    "op13_huffman_files": op13_huffman_files,
}

ORACLE: dict[str, str] = {
    "op4_bloom_cascade": URL_ORACLE,
    "op8_merkle_audit": FIXITY_ORACLE,
}
