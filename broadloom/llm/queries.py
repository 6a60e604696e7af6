"""The registered queries of this subpackage: thin functions ``(spark, folder) -> DataFrame`` over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from broadloom.llm import (
    byte_bpe, centroids, decontamination, licenses, merkle, ngram_join, passages, quality, secret_tags, sharding, simhash,
    token_files, warc,
)
from broadloom.llm.common import table
from broadloom.session import shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}


def op1_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.coded_documents(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN)


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contamination_report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op2_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archived_pages(table(spark, folder, "pages"), shared_path(spark, "warc"))


QUERIES["op2_warc"], TWINS["op2_warc"] = op2_warc, warc.SQL


def op3_secret_tags(spark: SparkSession, folder: str) -> DataFrame:
    return secret_tags.secret_report(table(spark, folder, "documents"))


QUERIES["op3_secret_tags"] = op3_secret_tags


def op4_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_report(table(spark, folder, "documents"))


QUERIES["op4_licenses"], TWINS["op4_licenses"] = op4_licenses, licenses.SQL


def op5_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_path(spark, "token-files")
    token_files.write_token_files(table(spark, folder, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.document_checksums(spark, path)


QUERIES["op5_token_files"] = op5_token_files
def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.place(table(spark, folder, "documents"), sharding.TREE, grown=sharding.GROWN)


QUERIES["op8_sharding"], TWINS["op8_sharding"] = op8_sharding, sharding.SQL
def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.verdicts(table(spark, folder, "documents"), table(spark, folder, "labels"))


QUERIES["op7_quality"], TWINS["op7_quality"] = op7_quality, quality.SQL
def op6_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, folder, "documents"))


QUERIES["op6_ngram_join"], TWINS["op6_ngram_join"] = op6_ngram_join, ngram_join.SQL
def op10_passages(spark: SparkSession, folder: str) -> DataFrame:
    return passages.repeated_passages(table(spark, folder, "documents"))


QUERIES["op10_passages"] = op10_passages
TWINS["op9_decontamination"] = decontamination.SQL
QUERIES["op9_decontamination"] = op9_decontamination
QUERIES["op1_byte_bpe"] = op1_byte_bpe


def op11_merkle(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.document_proofs(table(spark, folder, "documents"))


QUERIES["op11_merkle"], TWINS["op11_merkle"] = op11_merkle, merkle.SQL


def op12_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


QUERIES["op12_simhash"] = op12_simhash


def op13_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.embedding_clusters(table(spark, folder, "embeddings"))


QUERIES["op13_centroids"], TWINS["op13_centroids"] = op13_centroids, centroids.SQL
