"""The index of a source tree: build, look up, search, export."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema as S
from .config import Config, exists, prepare_folder
from .functions import scalar
from .graph import CodeGraph
from .operators import exports, incremental, resolve, structural, traversal, vector
from .page import render
from .sources import files as src


Model = Callable[[str, str], str]


@dataclass(frozen=True)
class BuildReport:
    new: int
    changed: int
    unchanged: int
    deleted: int
    errors: tuple[str, ...]


@dataclass(frozen=True)
class LookUp:
    """The answer to one look-up: the nodes found, in order of id, and a message."""

    operator: str
    subject: str
    nodes: tuple[dict, ...]
    message: str

    def as_dict(self) -> dict:
        return {"operator": self.operator, "subject": self.subject, "message": self.message, "nodes": list(self.nodes)}


class Index:
    """Opened on a project's root; its tables live in the project's index folder, or in ``store`` where given.

    Stored edges are raw: calls by name are resolved when the graph is read, so that an incremental build gives what
    a fresh one does. ``embedder`` takes a text column to a vector column and ``model`` a system and a user prompt to an answer; both
    come from the settings where they are not given.
    """

    def __init__(self, spark: SparkSession, root: str, config: Config | None = None, store: str | None = None, embedder: Callable[[Column], Column] | None = None, model: Model | None = None) -> None:
        self.spark, self.root = spark, str(root)
        self.config = config or Config.load(root)
        self.embedder = embedder or self.config.embed() or vector.embed
        self.model = model or self.config.explainer()
        self._store = store
        self._graph: CodeGraph | None = None

    @property
    def store(self) -> str:
        return self._store or str(prepare_folder(self.root))

    def _versions(self) -> str | None:
        """The folder of the last whole build."""
        mark = f"{self.store}/current"
        path = self.spark._jvm.org.apache.hadoop.fs.Path(mark)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return self.spark.read.text(mark).first()["value"] if fs.exists(path) else None

    def exists(self) -> bool:
        return self._versions() is not None or exists(self.root)

    def build(self, fresh: bool = False) -> BuildReport:
        """Parse what is new or has changed, drop what has gone, embed changed symbols; write all tables anew, then switch to them."""
        was = None if fresh else self._versions()
        found = src.scan(self.spark, self.root, self.config.exclude)
        old = src.load_state(self.spark, f"{was}/state") if was else self.spark.createDataFrame([], S.STATE_SCHEMA)
        status = incremental.diff_files(found.drop("content"), old, self.config.content_only).persist()
        counts = {r["status"]: r["count"] for r in status.groupBy("status").count().collect()}
        graph = CodeGraph.load(self.spark, f"{was}/graph") if was else CodeGraph.empty(self.spark)
        vectors = self.spark.read.schema(S.VECTOR_SCHEMA).parquet(f"{was}/vectors") if was else self.spark.createDataFrame([], S.VECTOR_SCHEMA)
        todo = found.join(status.filter(F.col("status").isin("new", "changed")).select("path"), "path", "left_semi")
        parsed = src.parse(todo, self.config.options()).persist()
        graph = graph.remove_files(status.filter("status = 'deleted'").select("path"))
        graph = incremental.integrate(graph, src.nodes_of(parsed), src.edges_of(parsed), todo.select("path", "language"))
        to = f"{self.store}/build-{datetime.now(timezone.utc).strftime('%Y%m%d%H%M%S%f')}"
        graph.save(f"{to}/graph")
        graph = CodeGraph.load(self.spark, f"{to}/graph")
        vector.upsert_vectors(vectors, graph.nodes, self.embedder).write.parquet(f"{to}/vectors")
        src.save_state(found, f"{to}/state")
        errors = tuple(r["message"] for r in src.errors_of(parsed).orderBy("message").collect())
        self.spark.createDataFrame([(to,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.store}/current")
        if was:
            old_path = self.spark._jvm.org.apache.hadoop.fs.Path(was)
            old_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old_path, True)
        status.unpersist()
        parsed.unpersist()
        self._graph = None
        return BuildReport(*(counts.get(k, 0) for k in ("new", "changed", "unchanged", "deleted")), errors)

    @property
    def raw(self) -> CodeGraph:
        where = self._versions()
        return CodeGraph.load(self.spark, f"{where}/graph") if where else CodeGraph.empty(self.spark)

    @property
    def graph(self) -> CodeGraph:
        """Calls resolved by name, imported modules as nodes."""
        if self._graph is None:
            g = resolve.resolve_calls(self.raw).with_externals()
            self._graph = CodeGraph(g.nodes.cache(), g.edges.cache())
        return self._graph

    @property
    def vectors(self) -> DataFrame:
        where = self._versions()
        return self.spark.read.schema(S.VECTOR_SCHEMA).parquet(f"{where}/vectors") if where else self.spark.createDataFrame([], S.VECTOR_SCHEMA)

    def look_up(self, operator: str, subject: str) -> DataFrame:
        return structural.look_up(self.graph, operator, subject)

    def ask(self, operator: str, subject: str) -> LookUp:
        """``look_up`` with its rows and the message that goes with them; ``find_symbol`` looks for a name."""
        df = self.find(subject) if operator == "find_symbol" else self.look_up(operator, subject)
        rows = tuple(r.asDict(recursive=True) for r in df.select(*S.NODE_COLUMNS).orderBy("node_id").collect())
        return LookUp(operator, subject, rows, scalar.MESSAGES[operator].format(n=len(rows), x=subject))

    def call_chain(self, source: str, target: str) -> DataFrame:
        return traversal.call_chain(self.graph, source, target)

    def find(self, name: str) -> DataFrame:
        return self.graph.find(name)

    def query(self, text: str, limit: int = 10, explain: bool = False, model: Model | None = None) -> dict:
        """The symbols that fit ``text`` best, each with its callers and callees; with ``explain`` what ``model`` says of them."""
        asked = self.spark.createDataFrame([("q", text)], "query_id string, text string").select("query_id", self.embedder(F.col("text")).alias("embedding"))
        found = vector.search(self.graph, self.vectors, asked, limit).persist()
        rows = found.join(self.graph.nodes.drop("body"), "node_id").orderBy("pos").collect()
        said = vector.explain(self.graph, found, text, model or self.model) if explain else ""
        found.unpersist()
        return {"query": text, "hits": [r.asDict(recursive=True) for r in rows], "explanation": said}

    def stats(self) -> dict:
        pairs = lambda df: {r[0]: r[1] for r in df.orderBy(F.desc("n")).collect()}
        g = self.graph
        return {**g.totals().first().asDict(), "by_kind": pairs(g.by_kind()), "by_edge": pairs(g.by_edge()), "by_language": pairs(g.by_language())}

    def vector_count(self) -> int:
        return self.vectors.count()

    def vector_bytes(self) -> int:
        where = self._versions()
        if not where:
            return 0
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{where}/vectors")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()

    def html(self) -> str:
        return render(exports.export_flow(self.graph), Path(self.root).resolve().name)

    def viz(self, output: str | Path) -> Path:
        """The flow view as a page of its own."""
        out = Path(output)
        out.parent.mkdir(parents=True, exist_ok=True)
        out.write_text(self.html(), encoding="utf-8")
        return out

    def subgraph(self, seeds: list[str], hops: int = 1) -> dict:
        ids = traversal.k_hop(self.graph, self.spark.createDataFrame([(s,) for s in seeds], "node_id string"), hops)
        return exports.export_elements(traversal.induced(self.graph, ids))

    def node(self, node_id: str) -> dict | None:
        row = structural.node_detail(self.graph, node_id).first()
        return json.loads(json.dumps(row.asDict(recursive=True))) if row else None
