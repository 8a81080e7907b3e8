"""What grows with the tables: exchanges of plans, the parts of a frequent name, the kinds that are built."""

from __future__ import annotations

import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph import schema as S
from weftgraph import storage
from weftgraph.graph import CodeGraph
from weftgraph.operators import exports, resolve, structural, vector
from weftgraph.plans import projection
from weftgraph.plans.queries import QUERIES

DIR = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(DIR).is_dir(), reason="no test tables here")


@pytest.fixture
def plain(spark):
    """Plans as they are at first, without broadcasts by size."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture
def calls(plain):
    """Thirty functions in three files; each calls the next two, the first of them twice."""
    ids = [f"{'abc'[i % 3]}::{i:02}" for i in range(30)]
    nodes = plain.createDataFrame([(x, "function", "same", x[0], i) for i, x in enumerate(ids)], "node_id string, kind string, name string, file string, line int")
    edges = [(a, ids[(i + d) % 30], "CALLS") for i, a in enumerate(ids) for d in (1, 1, 2)]
    return CodeGraph.of(nodes, plain.createDataFrame(edges, S.EDGE_SCHEMA))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df) -> int:
    return len(re.findall(r"(?<!Reused)Exchange hashpartitioning", plan(df)))


@needs_data
def test_only_the_kinds_asked_for_are_built(spark, tmp_path):
    where = tmp_path / "star"
    where.symlink_to(DIR)
    made = lambda: sorted(str(p.relative_to(at)) for p in at.glob("*/kind=*"))
    assert QUERIES["autocomplete"](spark, str(where)).count() == 40
    at = Path(next(v for k, v in projection._built.items() if k[1] == f"star {where}").removeprefix("file:").replace("//", "/"))
    assert made() == sorted(f"nodes/kind={k}" for k in projection.STAR_NODES)
    assert QUERIES["superclasses"](spark, str(where)).count() == 150
    assert [x for x in made() if x.startswith("edges")] == ["edges/kind=INHERITS"]


def test_spread_follows_the_rows(plain, monkeypatch):
    monkeypatch.setattr(storage, "TASK_ROWS", 10)
    df = plain.range(95).withColumn("k", F.col("id") % 50)
    assert storage.spread(df, 95, "k").rdd.getNumPartitions() == 10
    assert "Broadcast" not in plan(df.join(storage.small(plain.range(3)), "id")) or storage.BROADCAST_ROWS >= 3
    monkeypatch.setattr(storage, "BROADCAST_ROWS", 2)
    assert "Broadcast" not in plan(df.join(storage.small(plain.range(3)), "id"))


def test_calls_are_exchanged_once_for_each_end(calls):
    """Callers once, flows and links twice; besides, nodes by id, pairs of files, places by file."""
    assert exchanges(structural.callers(calls)) == 2
    assert exchanges(structural.callees(calls)) == 2
    assert exchanges(exports.flow_edges(calls)) <= 5
    assert exchanges(exports.flow_links(calls)) <= 7
    assert {tuple(r) for r in exports.flow_edges(calls).collect()} == {("a", "b", 20), ("b", "c", 20), ("c", "a", 20), ("a", "c", 10), ("b", "a", 10), ("c", "b", 10)}


def test_calls_meet_a_few_hits_without_an_exchange(calls):
    spark = calls.nodes.sparkSession
    direct = spark.createDataFrame([("q", "a::00", 0.1, 1), ("q", "b::01", 0.2, 2)], "query_id string, node_id string, distance double, pos int")
    more = vector.expand(calls, direct)
    assert {r["node_id"] for r in more.collect()} == {"c::02", "a::03", "b::28", "c::29"}
    assert "Exchange hashpartitioning(src" not in plan(more) and "Exchange hashpartitioning(tgt" not in plan(more)
    found = vector.context(calls, direct.filter("pos = 1"))
    r = found.first()
    assert (r["callers"], r["callees"]) == (["b::28", "c::29"], ["b::01", "c::02"])
    assert len(re.findall(r"BroadcastHashJoin \[(?:src|tgt)#\d+\], \[(?:src|tgt)#\d+\], LeftSemi", plan(found))) == 2


def test_a_few_files_are_removed_without_an_exchange_of_edges(calls):
    left = calls.remove_files(calls.nodes.sparkSession.createDataFrame([("a",)], "path string"))
    assert left.edges.count() == 30 and exchanges(left.edges) == 0


def test_elements_in_parts_are_exchanged_once(calls):
    lists = exports.edges_by_kind(calls, 7)
    rows = lists.collect()
    assert len({(r["kind"], r["part"]) for r in rows}) == len(rows) > 5
    assert sorted(e["id"] for r in rows for e in r["edges"]) == sorted(r["id"] for r in exports.edge_elements(calls).collect())
    assert exchanges(lists) == 1
    many = CodeGraph(calls.nodes, calls.edges.limit(1).crossJoin(calls.edges.sparkSession.range(50)).select(*S.EDGE_COLUMNS))
    assert sorted(len(r["edges"]) for r in exports.edges_by_kind(many, 20).collect()) == [10, 20, 20]


def test_a_frequent_name_is_paired_in_parts(calls, monkeypatch):
    monkeypatch.setattr(resolve, "PART", 4)
    nodes = calls.nodes
    loose = nodes.select(F.col("node_id").alias("src"), F.concat(F.lit(S.UNRESOLVED_PREFIX), "name").alias("tgt"), F.lit(S.CALLS).alias("kind"))
    got = resolve.resolve_edges(CodeGraph(nodes, loose))
    ids = [r[0] for r in nodes.select("node_id").collect()]
    assert sorted((r["src"], r["tgt"]) for r in got.collect()) == sorted((a, b) for a in ids for b in ids if a != b)
    assert sum(n > 0 for n in got.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()) > 8


def test_a_query_is_not_copied_for_each_cell(spark):
    rng = np.random.default_rng(0)
    v = spark.createDataFrame([(f"{i:03}", x.tolist()) for i, x in enumerate(rng.normal(size=(300, 8)))], "node_id string, embedding array<float>")
    index, asked = vector.CellIndex.fit(v, 20), v.limit(30).withColumnRenamed("node_id", "query_id")
    got = index.top_k(asked, 5, probes=20, block=16)
    assert [tuple(r) for r in got.orderBy("query_id", "rank").collect()] == [tuple(r) for r in vector.top_k_all(v, asked, 5).orderBy("query_id", "rank").collect()]
    sent = vector._blocks(asked, "query_id", "q", 16, index.centres, 20)
    assert sent.agg(F.sum(F.size("ids_q"))).first()[0] == 30
    few = index.top_k(asked, 300, probes=1).groupBy("query_id").count().collect()
    assert len(few) == 30 and max(r["count"] for r in few) < 300
