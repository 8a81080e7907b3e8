"""The registered queries of the ten operators: their SQL, and for the others invariants over whole tables."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__ as entry
from weftgraph.llm import bpe, fingerprints, huffman, packing, quality
from weftgraph.llm.queries import CAPACITY, QUERIES, SHARDS, SQL

from ..oracle import same
from .test_set_operators import check_bins
from .test_text_operators import brute_repeats

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DIR).is_dir(), reason="no test tables here")


def test_all_are_registered():
    assert sorted(int(q.split("_")[0][2:]) for q in QUERIES) == list(range(1, 11)) and {*QUERIES, "pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert same(spark, QUERIES[name], SQL[name], DIR)


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}


def test_sharding(spark, documents):
    got = QUERIES["op1_sharding"](spark, DIR).collect()
    sizes = Counter(r["shard"] for r in got)
    assert {r["doc_id"]: r["text"] for r in got} == documents and len(got) == len(documents)
    assert len(sizes) == SHARDS and max(sizes.values()) - min(sizes.values()) <= 1


def test_tokens_and_bits(spark, documents):
    ids = {r["doc_id"]: list(r["token_ids"]) for r in QUERIES["op6_byte_level_bpe"](spark, DIR).collect()}
    back = bpe.decode(QUERIES["op6_byte_level_bpe"](spark, DIR), bpe.token_table(spark)).collect()
    assert {r["doc_id"]: r["decoded"] for r in back} == documents
    out = QUERIES["op9_token_output"](spark, DIR).cache()
    rows = out.filter("book_ids IS NULL")
    assert {r["doc_id"]: r["decoded"] for r in rows.collect()} == documents
    again = huffman.decompress(rows.drop("decoded"), huffman.read_book(out)).collect()  # by the output alone
    assert {r["doc_id"]: r["token_ids"] for r in again} == ids and len(again) == len(ids)
    out.unpersist()


def test_tokens_are_decoded_by_the_query(spark, documents):
    got = QUERIES["op6_byte_level_bpe"](spark, DIR).collect()
    assert {r["doc_id"]: r["decoded"] for r in got} == documents and len(got) == len(documents) and all(r["token_ids"] for r in got)


def test_packing(spark, documents):
    sizes = [(i, len(bpe.encoding(bpe.default_vocabulary()).encode_ordinary(t)) + 1) for i, t in documents.items()]
    check_bins(QUERIES["op10_best_fit_packing"](spark, DIR).collect(), sizes, CAPACITY)


def test_fingerprints_catch_benchmark_passages(spark, documents):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()}
    got = {r["doc_id"]: r for r in QUERIES["op3_document_fingerprints"](spark, DIR).collect()}
    assert len(got) == len(documents)
    for i, t in documents.items():
        found = {s["item_id"] for s in got[i]["spans"]}
        assert {k for k, x in items.items() if x in t} <= found
        for s in got[i]["spans"]:
            assert t[s["start"] : s["start"] + s["length"]] == items[s["item_id"]][s["item_start"] : s["item_start"] + s["length"]]


def test_fingerprints_catch_repeated_passages(spark, documents):
    ids = sorted(documents)
    got = {r["doc_id"]: [tuple(x) for x in r["repeats"]] for r in QUERIES["op3_document_fingerprints"](spark, DIR).collect()}
    assert got == dict(zip(ids, brute_repeats([documents[i] for i in ids], fingerprints.WINDOW))) and any(got.values())


def test_fingerprints_catch_short_benchmark_items(spark):
    at = "/root/testdata/sf0.1"
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{at}/benchmark.parquet").collect()}
    got = {(r["doc_id"], s["item_id"]) for r in QUERIES["op3_document_fingerprints"](spark, at).filter("size(spans) > 0").collect() for s in r["spans"]}
    held = {(r["doc_id"], k) for r in spark.read.parquet(f"{at}/documents.parquet").toLocalIterator() for k, x in items.items() if x in r["text"]}
    assert held <= got and {(1137, 155), (4466, 102), (9148, 162)} <= held


def test_pipeline_keeps_clean_documents(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    kept = {r["doc_id"] for r in quality.accepted(docs).collect()}
    good, bad = [i for i, q in labels.items() if q], [i for i, q in labels.items() if not q]
    assert sum(i in kept for i in good) >= 0.98 * len(good) and sum(i in kept for i in bad) <= 0.1 * len(bad)
    bins = QUERIES["op10_best_fit_packing"](spark, DIR).count()
    assert 0 < entry.queries()["pipeline"](spark, DIR).count() < bins and packing.best_fit([], 5) == []


def test_licenses_and_pages(spark, documents):
    found = QUERIES["op7_license_scan"](spark, DIR).collect()
    assert {r["doc_id"] for r in found} >= {i for i, t in documents.items() if "is licensed under the GNU General Public License" in t}
    pages = QUERIES["op8_html_extraction"](spark, DIR).collect()
    assert len(pages) == spark.read.parquet(f"{DIR}/pages.parquet").count() and all(r["text"] for r in pages)
