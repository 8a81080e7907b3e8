"""Every query of the graph operators against its SQL, and what the entry module promises."""

from __future__ import annotations

import re
from pathlib import Path

import pytest

import __spark_entry__ as entry
from weftgraph.operators import vector
from weftgraph.plans.queries import QUERIES, SQL

from .oracle import same

DIR = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]
needs_data = pytest.mark.skipif(not Path(DIR).is_dir(), reason="no test tables here")


@needs_data
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert same(spark, QUERIES[name], SQL[name], DIR)


@needs_data
@pytest.mark.parametrize("sf_dir", [DIR, "/root/testdata/sf0.1"])
def test_recall_of_the_cell_index(spark, sf_dir):
    """Against all of the exact search's hits; the index holds every vector."""
    exact, near = ({(r["query_id"], r["node_id"]): r["distance"] for r in QUERIES[q](spark, sf_dir).collect()} for q in ("vector_topk", "vector_topk_near"))
    assert len(near) == len(exact) and len(exact.keys() & near.keys()) >= 0.9 * len(exact)
    assert all(exact[k] == near[k] for k in exact.keys() & near.keys())
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr("CAST(vec_id AS STRING) AS node_id", "embedding")
    assert vector.CellIndex.fit(v).cells.count() == v.count()


def test_cell_index_of_odd_vectors(spark):
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [0.0, 0.0]), ("d", None), (None, [1.0, 1.0]), ("e", [1.0]), ("a2", [1.0, 0.0])]
    v = spark.createDataFrame(rows, "node_id string, embedding array<float>")
    got = vector.CellIndex.fit(v, 2).top_k(spark.createDataFrame([("q", [1.0, 0.0]), ("n", None), (None, [1.0, 0.0])], "query_id string, embedding array<float>"), 3, probes=2).orderBy("rank").collect()
    assert [(r["query_id"], r["node_id"], r["distance"]) for r in got] == [("q", "a", 0.0), ("q", "a2", 0.0), ("q", "b", 1.0)]
    assert vector.CellIndex.fit(v.limit(0)).top_k(v.limit(0).withColumnRenamed("node_id", "query_id"), 3).count() == 0


@needs_data
def test_entry(spark):
    assert entry.entry(spark).columns == ["source", "target", "weight"]


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())


def test_nothing_else_imports_the_training_data_operators():
    for p in [*ROOT.glob("weftgraph/**/*.py"), *ROOT.glob("tests/*.py"), ROOT / "bench.py"]:
        if "llm" not in p.relative_to(ROOT).parts and p != Path(__file__).resolve():
            assert not re.search(r"^\s*(from|import)\b.*\b(llm|corpus_pipeline)\b", p.read_text(), re.M), p


def test_distances_and_chains_beyond_twelve_calls(spark, tmp_path):
    events = spark.range(15).selectExpr("id AS event_id", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, id) AS ts", "id + 10 AS user_id", "'click' AS event_type")
    events.write.parquet(f"{tmp_path}/events.parquet")
    users = [f"user::{k + 10}" for k in range(15)]
    assert {r["node_id"]: r["depth"] for r in QUERIES["bfs_distance"](spark, str(tmp_path)).collect()} == {u: k for k, u in enumerate(users)}
    assert [r["node_id"] for r in QUERIES["call_chain"](spark, str(tmp_path)).orderBy("pos").collect()] == users
