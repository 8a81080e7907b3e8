"""The index end to end on source trees written for the tests."""

from __future__ import annotations

import json
import threading
import urllib.request
from pathlib import Path

import pytest

from pyspark.sql import functions as F

from weftgraph import Config, Index, config, storage
from weftgraph.cli import serve
from weftgraph.graph import CodeGraph
from weftgraph.sources import files as src
from weftgraph.streaming.ingest import ingest

A = "import os\n\ndef helper(x):\n    '''Helps with numbers.'''\n    return x\n\ndef main():\n    return shared(helper(1))\n"
B = "from a import helper\n\ndef shared(y):\n    '''Shared between files.'''\n    return y\n\nclass Animal:\n    def speak(self):\n        return helper(2)\n"


def rows(df):
    return sorted(map(str, (r.asDict() for r in df.collect())))


@pytest.fixture
def project(tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "a.py").write_text(A)
    (tmp_path / "pkg" / "b.py").write_text(B)
    (tmp_path / "node_modules" / "x.js").write_text("function no() {}")
    (tmp_path / "notes.txt").write_text("no source")
    (tmp_path / ".gitignore").write_text("*.pyc")
    return tmp_path


def test_build_look_up_and_rebuild(spark, project):
    index = Index(spark, str(project))
    assert not index.exists() and index.graph.nodes.count() == 0
    index = Index(spark, str(project))
    report = index.build()
    assert (report.new, report.changed, report.deleted, report.errors) == (2, 0, 0, ())
    assert (project / ".gitignore").read_text() == "*.pyc\n.weftgraph/\n"
    ids = lambda df: sorted(r["node_id"] for r in df.collect())
    assert ids(index.look_up("callers", "pkg/b.py::shared")) == ["a.py::main"]
    assert ids(index.look_up("callers", "a.py::helper")) == ["a.py::main", "pkg/b.py::Animal::speak"]
    assert ids(index.look_up("imports_of", "a.py")) == ["ext::os"]
    assert [r["node_id"] for r in index.call_chain("a.py::main", "pkg/b.py::shared").orderBy("pos").collect()] == ["a.py::main", "pkg/b.py::shared"]
    assert ids(index.find("ANIMAL")) == ["pkg/b.py::Animal"]
    s = index.stats()
    assert s["total_files"] == 2 and s["by_kind"]["function"] == 3 and index.vector_bytes() > 0
    assert index.build().unchanged == 2
    # a change in one file keeps the calls of the other, and an incremental build gives what a fresh one does
    (project / "a.py").write_text(A.replace("def helper(x)", "def helper(x, z=0)") + "\ndef extra():\n    return main()\n")
    r = index.build()
    assert (r.changed, r.unchanged) == (1, 1)
    assert ids(index.look_up("callers", "a.py::helper")) == ["a.py::main", "pkg/b.py::Animal::speak"]
    before = rows(index.graph.nodes), rows(index.graph.edges), rows(index.vectors)
    index.build(fresh=True)
    assert before == (rows(index.graph.nodes), rows(index.graph.edges), rows(index.vectors))
    (project / "pkg" / "b.py").unlink()
    assert index.build().deleted == 1
    assert ids(index.look_up("callers", "a.py::helper")) == ["a.py::main"] and not [i for i in ids(index.graph.nodes) if i.startswith("pkg")]


def test_query_page_and_server(spark, project, tmp_path):
    index = Index(spark, str(project), Config(max_body_lines=1))
    index.build()
    got = index.query("shared between files", 2, explain=True)
    assert got["hits"][0]["node_id"] == "pkg/b.py::shared" and len(got["hits"]) == 2 and "model" in got["explanation"]
    page = index.viz(tmp_path / "out" / "g.html").read_text()
    data = json.loads(page.split('id="data">')[1].split("</script>")[0])
    assert {n["id"] for n in data["level1"]["nodes"]} == {"a.py", "pkg/b.py"} and "@" + "DATA@" not in page
    assert index.subgraph(["a.py::main"])["stats"]["node_count"] == 4
    server = serve(index, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    get = lambda p: urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}{p}").read().decode()
    try:
        assert json.loads(get("/api/stats"))["total_files"] == 2
        assert json.loads(get("/api/node/a.py::main"))["callees"][0]["node_id"] in ("a.py::helper", "pkg/b.py::shared")
        assert json.loads(get("/api/query?q=shared&limit=1"))["hits"] and get("/").startswith("<!doctype html>")
        with pytest.raises(urllib.error.HTTPError):
            get("/api/node/nothing")
    finally:
        server.shutdown()


def test_scan_and_errors(spark, tmp_path):
    (tmp_path / "bad name+x.py").write_bytes(b"def f(:\n    '\xff'\n")
    (tmp_path / "empty.go").write_text("")
    (tmp_path / "blank.go").write_text("\n")
    found = src.scan(spark, str(tmp_path), exclude=["*.rs"]).collect()
    assert {(r["path"], r["language"]) for r in found} == {("bad name+x.py", "python"), ("blank.go", "go"), ("empty.go", "go")}
    index = Index(spark, str(tmp_path))
    report = index.build()
    assert len(report.errors) == 1 and report.errors[0].startswith("bad name+x.py: SyntaxError") and report.new == 3


def test_sql_table_function(spark):
    src.register_sql(spark)
    spark.createDataFrame([("m.py", "def f():\n    g()\n")], "path string, text string").createOrReplaceTempView("some_files")
    got = spark.sql("SELECT p.rec_type, p.node_id, p.src, p.tgt FROM some_files t, LATERAL parse_source(t.path, t.text) p").collect()
    assert [tuple(r) for r in got] == [("node", "m.py::f", None, None), ("edge", None, "m.py::f", "ext::__unresolved__::g")]


def test_config(project, monkeypatch):
    (project / ".weftgraph").mkdir()
    (project / ".weftgraph" / "config.toml").write_text('exclude = ["x*"]\nmodel_name = "file"\nunknown = 1\n')
    c = Config.load(project, max_body_lines=3)
    assert "x*" in c.excludes and "**/dist/**" in c.excludes and c.model_name == "file" and c.max_body_lines == 3
    monkeypatch.setenv("OPENAI_MODEL", "env")
    assert Config.load(project).model_name == "env"


def test_streaming_ingest(spark, project, tmp_path):
    drop, store, marks = tmp_path / "drop", tmp_path / "store", tmp_path / "marks"
    drop.mkdir()
    (drop / "a.py").write_text(A)
    ingest(spark, str(drop), str(store), str(marks)).awaitTermination(120)
    (drop / "b.py").write_text(B)
    ingest(spark, str(drop), str(store), str(marks)).awaitTermination(120)
    g = CodeGraph.load(spark, f"{store}/batch-1")
    assert {r["node_id"] for r in g.nodes.filter("kind = 'file'").collect()} == {"a.py", "b.py"} and g.nodes.count() == 7


def shout(system, prompt):
    return f"{len(system) > 0} {prompt.splitlines()[0]}"


def lengths(text):
    """A stand-in for a model: the text's length and a constant."""
    return F.array(F.length(F.coalesce(text, F.lit(""))).cast("float"), F.lit(1.0).cast("float"))


def test_empty_files_and_a_corrupt_state(spark, project):
    (project / "pkg" / "__init__.py").write_text("")
    index = Index(spark, str(project))
    assert index.build().new == 3 and index.exists() and config.exists(project)
    assert index.graph.node("pkg/__init__.py").first()["kind"] == "file"
    assert index.build().unchanged == 3 and index.vector_count() == index.vectors.count() > 0
    for f in Path(index._versions(), "state").glob("*.parquet"):
        f.write_bytes(b"no parquet at all")
        f.with_name(f".{f.name}.crc").unlink(missing_ok=True)
    report = index.build()
    assert (report.new, report.unchanged) == (3, 0) and index.graph.symbols().count() == 5


def test_model_embedder_and_answers(spark, project, monkeypatch):
    monkeypatch.setenv("WEFTGRAPH_MODEL", "tests.test_engine:shout")
    index = Index(spark, str(project), Config(embedder="tests.test_engine:lengths"))
    index.build()
    assert len(index.vectors.first()["embedding"]) == 2
    got = index.query("numbers", 2, explain=True)
    assert got["explanation"] == "True Question: numbers" and len(got["hits"]) == 2
    answer = index.ask("callers", "a.py::helper")
    assert [n["node_id"] for n in answer.nodes] == ["a.py::main", "pkg/b.py::Animal::speak"] and answer.message == "2 caller(s) of 'a.py::helper'"
    assert index.ask("find_symbol", "SHARED").as_dict()["message"] == "Found 1 symbol(s) named 'SHARED'" and index.ask("callees", "nobody").nodes == ()


def test_sweep(spark):
    kept = storage.stash(spark.range(3), "some")
    assert kept.count() == 3
    path = storage._made[spark.sparkContext.applicationId][-1].removeprefix("file:")
    assert Path(path).is_dir() and storage.sweep(spark) >= 1 and not Path(path).exists() and storage.sweep(spark) == 0
