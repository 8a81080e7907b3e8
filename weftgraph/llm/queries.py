"""The registered queries of the ten operators, with production parameters, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from . import bpe, fingerprints, html_extract, huffman, jaccard, langid, licenses, packing, quality, sharding
from .common import read, stash

Query = Callable[[SparkSession, str], DataFrame]

SHARDS, SEED = 64, 20
CAPACITY = 32768


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(ship(spark), sf_dir, "documents"), SHARDS, SEED)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.accepted(read(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.accepted(read(ship(spark), sf_dir, "documents"))


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's fingerprint, its equals, and the maximal spans it shares with benchmark items."""
    return fingerprints.fingerprint(read(ship(spark), sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's class and number of links."""
    return jaccard.links(read(ship(spark), sf_dir, "documents"))


def op6_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the text that they decode to."""
    return bpe.decode(bpe.encode(read(ship(spark), sf_dir, "documents")), bpe.token_table(spark))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(ship(spark), sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(ship(spark), sf_dir, "pages"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document as Huffman bits with checkpoints, and ``decoded``, the text that bits and token table give back.

    One more row, without ``doc_id``, has the code book, so that the output can be decoded by itself.
    """
    ids = stash(bpe.encode_rows(read(ship(spark), sf_dir, "documents")), "token-ids")
    book = huffman.build_book(ids)
    step = bpe.joined(bpe.token_table(spark))
    back = huffman.decompress(huffman.compress(ids, book), book, keep=True, into=("decoded", T.BinaryType(), step))
    text = back.withColumn("decoded", F.make_valid_utf8(F.col("decoded").cast("string")))
    return text.unionByName(huffman.book_row(spark, book), allowMissingColumns=True)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of documents by their numbers of byte-level BPE tokens, each with one separator."""
    return packing.pack(bpe.count_rows(read(ship(spark), sf_dir, "documents")), CAPACITY, "n_tokens + 1")


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_sharding, op2_quality_rules, op3_document_fingerprints, op4_language_id, op5_ngram_jaccard_join, op6_byte_level_bpe, op7_license_scan, op8_html_extraction, op9_token_output, op10_best_fit_packing)}

SQL: dict[str, str] = {"op2_quality_rules": quality.oracle(), "op4_language_id": langid.oracle(), "op5_ngram_jaccard_join": jaccard.oracle()}
