"""The graph's operators on small graphs made by hand."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from weftgraph import schema as S
from weftgraph.graph import CodeGraph
from weftgraph.operators import exports, incremental, resolve, structural, traversal, vector


def make(spark, nodes, edges):
    """nodes: (id, kind, name, file, line)."""
    n = spark.createDataFrame([tuple(x) for x in nodes], "node_id string, kind string, name string, file string, line int")
    return CodeGraph.of(n, spark.createDataFrame(edges, S.EDGE_SCHEMA))


def ids(df, c="node_id"):
    return sorted(r[c] for r in df.select(c).collect())


@pytest.fixture(scope="module")
def g(spark):
    nodes = [
        ("a.py", "file", "a.py", "a.py", 0), ("b.py", "file", "b.py", "b.py", 0),
        ("a.py::a", "function", "a", "a.py", 1), ("a.py::b", "function", "b", "a.py", 5), ("b.py::c", "function", "c", "b.py", 1), ("b.py::A", "class", "Same", "b.py", 9),
        ("b.py::A::m", "method", "same", "b.py", 10), ("b.py::Sub", "class", "Sub", "b.py", 20), ("b.py::SubSub", "class", "SubSub", "b.py", 30),
    ]
    edges = [
        ("a.py::a", "a.py::b", "CALLS"), ("a.py::a", "a.py::b", "CALLS"), ("a.py::a", "a.py::b", "IMPORTS"), ("a.py::b", "b.py::c", "CALLS"), ("a.py::a", "b.py::A", "IMPLEMENTS"),
        ("b.py::Sub", "b.py::A", "INHERITS"), ("b.py::SubSub", "b.py::Sub", "INHERITS"), ("b.py::A", "b.py::A::m", "CONTAINS"), ("b.py", "b.py::A", "DEFINES"), ("b.py", "b.py::c", "DEFINES"),
        ("a.py", "ext::os", "IMPORTS"), ("a.py::a", "ext::__unresolved__::same", "CALLS"), ("a.py", "a.py::a", "DEFINES"), ("a.py", "gone", "DEFINES"),
    ]
    return make(spark, nodes, edges)


def test_lookups(g):
    assert ids(structural.callers(g, "a.py::b")) == ["a.py::a"]
    assert ids(structural.callees(g, "a.py::a")) == ["a.py::b"]
    assert ids(structural.subclasses(g, "b.py::A")) == ["b.py::Sub"]
    assert ids(structural.superclasses(g, ["b.py::SubSub"])) == ["b.py::Sub"]
    assert ids(structural.implementors(g, "b.py::A")) == ["a.py::a"]
    assert ids(structural.imports_of(g, "a.py")) == ["ext::os"]
    assert ids(structural.callers(g, "nowhere")) == []
    assert ids(g.find("SAME")) == ["b.py::A", "b.py::A::m"]
    assert ids(g.node("a.py")) == ["a.py"] and ids(g.nodes_of_file("a.py")) == ["a.py::a", "a.py::b"]
    assert ids(g.autocomplete("SUB")) == ["b.py::Sub", "b.py::SubSub"] and len(ids(g.autocomplete("py", 3))) == 3


def test_messages(spark, g):
    subjects = structural.subject_table(spark, ["a.py::b", "nowhere"])
    got = {r["subject"]: r["message"] for r in structural.messages(structural.callers(g, subjects), "callers", subjects).collect()}
    assert got == {"a.py::b": "1 caller(s) of 'a.py::b'", "nowhere": "0 caller(s) of 'nowhere'"}


def test_node_detail(g):
    row = structural.node_detail(g, "a.py::b").first()
    assert [x["node_id"] for x in row["callers"]] == ["a.py::a"] and [x["node_id"] for x in row["callees"]] == ["b.py::c"]
    assert structural.node_detail(g, "zzz").first() is None


def test_statistics_and_ghosts(g):
    t = g.totals().first().asDict()
    assert t == {"total_nodes": 9, "total_files": 2, "total_edges": 14, "total_ghosts": 3}
    assert {r["kind"]: r["n"] for r in g.by_edge().collect()}["CALLS"] == 4
    assert ids(g.ghosts()) == ["ext::__unresolved__::same", "ext::os", "gone"]


def test_upsert_remove_add(spark, g):
    new = spark.createDataFrame([("a.py::a", "function", "a", "a.py", 7, 0), ("a.py::a", "function", "a", "a.py", 99, 1)], "node_id string, kind string, name string, file string, line int, o int")
    up = g.upsert_nodes(new, "o")
    assert up.node("a.py::a").first()["line"] == 99 and up.nodes.count() == 9
    left = g.remove_files(spark.createDataFrame([("a.py",), ("unknown",)], "path string"))
    assert ids(left.nodes) == ["b.py", "b.py::A", "b.py::A::m", "b.py::Sub", "b.py::SubSub", "b.py::c"]
    assert left.edges.filter("src like 'a.py%' or tgt like 'a.py%'").count() == 0 and left.edges.count() == 5


def test_call_chain_and_bfs(spark, g):
    chain = lambda a, b: [r["node_id"] for r in traversal.call_chain(g, a, b).orderBy("pos").collect()]
    assert chain("a.py::a", "b.py::c") == ["a.py::a", "a.py::b", "b.py::c"]
    assert chain("b.py::c", "a.py::a") == [] and chain("a.py::a", "a.py::a") == ["a.py::a"] and chain("no", "no") == []
    cyc = spark.createDataFrame([("1", "2"), ("2", "3"), ("3", "1"), ("1", "1"), ("1", "0"), ("0", "3"), (None, "9")], "src string, tgt string")
    got = {r["node_id"]: (r["depth"], r["path"]) for r in traversal.bfs(cyc, spark.createDataFrame([("1",)], "node_id string")).collect()}
    assert got == {"1": (0, ["1"]), "2": (1, ["1", "2"]), "0": (1, ["1", "0"]), "3": (2, ["1", "0", "3"])}


def test_k_hop(spark, g):
    seed = spark.createDataFrame([("b.py::Sub",), ("unknown",)], "node_id string")
    assert ids(traversal.k_hop(g, seed, 0)) == ["b.py::Sub", "unknown"]
    assert ids(traversal.k_hop(g, seed, 1)) == ["b.py::A", "b.py::Sub", "b.py::SubSub", "unknown"]
    sub = traversal.induced(g, traversal.k_hop(g, seed, 1))
    assert sub.edges.count() == 2 and sub.nodes.count() == 3
    assert len(ids(traversal.k_hop(g, seed, 9))) > 10


def test_resolution(spark, g):
    r = resolve.resolve_calls(g)
    assert {(x["src"], x["tgt"]) for x in r.edges.filter("kind = 'CALLS'").collect()} == {("a.py::a", "a.py::b"), ("a.py::b", "b.py::c"), ("a.py::a", "b.py::A::m")}
    assert r.edges.filter("kind = 'CALLS'").count() == 4
    calls = spark.createDataFrame([("f", "x", "n"), ("f", "x", "n"), ("f", "x", "zz")], "file string, src string, name string")
    syms = spark.createDataFrame([("f", "n", "second", 2), ("f", "n", "first", 1), ("g", "zz", "other", 0)], "file string, name string, node_id string, ordinal int")
    assert sorted(x["tgt"] for x in resolve.resolve_local(calls, syms).collect()) == ["ext::__unresolved__::zz", "first", "first"]


def test_resolve_bases(spark):
    h = make(spark, [("x::A", "class", "A", "x", 1), ("y::B", "class", "B", "y", 1)], [("x::A", "x::B", "INHERITS"), ("y::B", "y::Nope", "INHERITS"), ("x::A", "y::B", "CALLS")])
    assert {(r["src"], r["tgt"], r["kind"]) for r in resolve.resolve_bases(h).edges.collect()} == {("x::A", "y::B", "INHERITS"), ("y::B", "y::Nope", "INHERITS"), ("x::A", "y::B", "CALLS")}


def test_diff_files(spark):
    a = spark.createDataFrame([("same", 1.0, "x"), ("touched", 2.0, "x"), ("edited", 1.0, "y"), ("new", 1.0, "n"), ("nulls", None, None)], S.STATE_SCHEMA)
    b = spark.createDataFrame([("same", 1.0, "x"), ("touched", 1.0, "x"), ("edited", 1.0, "x"), ("old", 1.0, "o"), ("nulls", None, None)], S.STATE_SCHEMA)
    got = {r["path"]: r["status"] for r in incremental.diff_files(a, b).collect()}
    assert got == {"same": "unchanged", "touched": "changed", "edited": "changed", "new": "new", "old": "deleted", "nulls": "unchanged"}
    assert {r["path"]: r["status"] for r in incremental.diff_files(a, b, True).collect()}["touched"] == "unchanged"


def test_flows(g):
    assert [tuple(r) for r in exports.flow_edges(g).select("source", "target", "weight").collect()] == [("a.py", "b.py", 1)]
    n = {r["id"]: r for r in exports.flow_nodes(g).collect()}
    assert (n["a.py"]["out_degree"], n["b.py"]["in_degree"], n["b.py"]["symbol_count"], n["a.py"]["language"]) == (1, 1, 5, "python")
    assert [tuple(r) for r in exports.flow_links(g).select("file", "s", "t").collect()] == [("a.py", 0, 1)]
    flow = exports.export_flow(g)
    assert flow["stats"] == {"file_count": 2, "edge_count": 1, "node_count": 7} and json.loads(exports.to_json(flow))


def test_tree_and_elements(spark, g):
    rows = {(r["parent"], r["node_id"]): (r["depth"], r["pos"], r["kind"]) for r in exports.tree_rows(g).collect()}
    assert rows[("b.py", "b.py::A")] == (1, 0, "class") and rows[("b.py", "b.py::c")] == (1, 1, "function") and rows[("b.py::A", "b.py::A::m")] == (2, 0, "method")
    assert rows[("a.py", "gone")] == (1, 1, "unknown") and rows[(None, "a.py")] == (0, 0, "file")
    assert {r["parent"]: r["summary"] for r in exports.children_summary(g).collect()} == {"b.py": "1 class, 1 function", "b.py::A": "1 method", "a.py": "1 function"}
    e = ids(exports.edge_elements(g), "id")
    assert "a.py::a--CALLS--a.py::b" in e and "a.py::a--CALLS--a.py::b_1" in e and len(set(e)) == 14
    files = spark.createDataFrame([("top.py",), ("src/pkg/deep/x.py",), ("src/pkg/deep/y/z.py",), ("lib/a/one.py",), ("lib/b/two.py",)], "path string")
    got = {r["folder"]: (r["parent"], r["label"], r["n_files"]) for r in exports.folder_rows(files).collect()}
    assert got == {"src/pkg/deep": ("", "src/pkg/deep", 1), "src/pkg/deep/y": ("src/pkg/deep", "y", 1), "lib": ("", "lib", 0), "lib/a": ("lib", "a", 1), "lib/b": ("lib", "b", 1)}
    assert exports.export_tree(g)["tree"] and exports.export_elements(g)["stats"]["edge_count"] == 14
    kinds = {r["kind"]: len(r["edges"]) for r in exports.edges_by_kind(g).collect()}
    assert kinds["CALLS"] == 4 and kinds["DEFINES"] == 4


def test_save_and_load(spark, g, tmp_path):
    g.save(str(tmp_path / "g"))
    for h in (CodeGraph.load(spark, str(tmp_path / "g")),):
        assert sorted(map(tuple, h.nodes.collect())) == sorted(map(tuple, g.nodes.collect())) and sorted(map(tuple, h.edges.collect())) == sorted(map(tuple, g.edges.collect()))
    g.save_json(str(tmp_path / "j"))
    h = CodeGraph.load_json(spark, str(tmp_path / "j"))
    assert sorted(map(tuple, h.nodes.collect())) == sorted(map(tuple, g.nodes.collect())) and sorted(map(tuple, h.edges.collect())) == sorted(map(tuple, g.edges.collect()))
    doc = {"directed": True, "nodes": [{"id": "x", "kind": "class", "name": "X", "line": 3}], "links": [{"source": "x", "target": "y", "kind": "CALLS"}]}
    (tmp_path / "one.json").write_text(json.dumps(doc, indent=1))
    h = CodeGraph.load_json(spark, str(tmp_path / "one.json"))
    assert h.nodes.first()["line"] == 3 and h.edges.first()["tgt"] == "y"


def test_empty_graph(spark):
    h = CodeGraph.empty(spark)
    assert h.totals().first()["total_nodes"] == 0 and exports.flow_edges(h).count() == 0 and exports.tree_rows(h).count() == 0
    assert traversal.call_chain(h, "a", "b").count() == 0 and resolve.resolve_calls(h).edges.count() == 0 and exports.folder_rows(h.nodes.select(F.col("file").alias("path"))).count() == 0


def _vectors(spark, rows):
    return spark.createDataFrame(rows, S.VECTOR_SCHEMA)


def test_top_k(spark):
    v = _vectors(spark, [("a", "", [1.0, 0.0]), ("b", "", [1.0, 0.0]), ("c", "", [0.0, 1.0]), ("z", "", [0.0, 0.0]), ("n", "", None), ("w", "", [1.0])])
    assert [(r["node_id"], r["distance"]) for r in vector.top_k(v, [2.0, 0.0], 3).collect()] == [("a", 0.0), ("b", 0.0), ("c", 1.0)]
    assert vector.top_k(v.limit(0), [1.0, 0.0], 3).count() == 0
    q = spark.createDataFrame([("q1", [2.0, 0.0]), ("q2", [0.0, -1.0]), ("q3", None)], "query_id string, embedding array<float>")
    for block in (1, 2, 100):
        got = [tuple(r) for r in vector.top_k_all(v, q, 2, block).orderBy("query_id", "rank").select("query_id", "node_id", "distance").collect()]
        assert got == [("q1", "a", 0.0), ("q1", "b", 0.0), ("q2", "a", 1.0), ("q2", "b", 1.0)]


def test_search(spark, g):
    v = _vectors(spark, [("a.py::b", "", [1.0, 0.0]), ("b.py::Sub", "", [0.9, 0.1]), ("missing", "", [1.0, 0.0])])
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<float>")
    rows = vector.search(g, v, q, 3).orderBy("pos").collect()
    assert [(r["node_id"], r["is_expansion"]) for r in rows] == [("a.py::b", False), ("b.py::Sub", False), ("a.py::a", True)]
    assert rows[0]["callers"] == ["a.py::a"] and rows[0]["callees"] == ["b.py::c"] and rows[2]["distance"] == 1.0
    assert len(vector.search(g, v, q, 1).collect()) == 1
    held = vector.search(g, v, q, 2, expand_slots=1).orderBy("pos").collect()
    assert [r["is_expansion"] for r in held] == [False, True]
    asked = []
    said = vector.explain(g, vector.search(g, v, q, 3), "what?", lambda s, p: asked.append(p) or "so")
    assert said == "so" and "1. function b (a.py:5)" in asked[0] and "what?" in asked[0]
    assert "language model" in vector.explain(g, vector.search(g, v, q, 3), "what?")


def test_upsert_vectors(spark, g):
    first = vector.upsert_vectors(_vectors(spark, []), g.nodes)
    assert ids(first) == ["a.py::a", "a.py::b", "b.py::A", "b.py::A::m", "b.py::Sub", "b.py::SubSub", "b.py::c"]
    norm = first.select(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")).alias("n")).collect()
    assert all(abs(r["n"] - 1) < 1e-5 for r in norm)
    stale = _vectors(spark, [("gone", "gone", [1.0]), ("a.py::a", "a", [7.0])])
    second = {r["node_id"]: r["embedding"] for r in vector.upsert_vectors(stale, g.nodes).collect()}
    assert "gone" not in second and second["a.py::a"] == [7.0] and len(second) == 7
    assert ids(vector.delete_file(first, "b.py")) == ["a.py::a", "a.py::b"]
