"""The code graph: a pair of DataFrames with set operations, statistics and storage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import schema as S
from .functions import scalar
from .storage import small, stash


def conform_nodes(df: DataFrame) -> DataFrame:
    """``df`` with all node fields in their order; missing ones get their default."""
    have = set(df.columns)
    cols = []
    for f in S.NODE_SCHEMA.fields:
        if f.name in have:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        elif f.name == "decorators":
            cols.append(F.array().cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(S.DEFAULTS.get(f.name, "")).cast(f.dataType).alias(f.name))
    return df.select(*cols)


@dataclass(frozen=True)
class CodeGraph:
    """``nodes`` has one row a symbol (SCHEMA), ``edges`` is a bag of (src, tgt, kind)."""

    nodes: DataFrame
    edges: DataFrame

    @classmethod
    def of(cls, nodes: DataFrame, edges: DataFrame) -> CodeGraph:
        return cls(conform_nodes(nodes), edges.select(*S.EDGE_COLUMNS))

    @classmethod
    def empty(cls, spark: SparkSession) -> CodeGraph:
        return cls(spark.createDataFrame([], S.NODE_SCHEMA), spark.createDataFrame([], S.EDGE_SCHEMA))

    def stored(self) -> CodeGraph:
        """The graph as two tables in the shared folder, for operators that read it several times."""
        return CodeGraph(stash(self.nodes, "nodes"), stash(self.edges, "edges"))

    # Look-ups

    def node(self, node_id: str) -> DataFrame:
        return self.nodes.filter(F.col("node_id") == node_id)

    def symbols(self) -> DataFrame:
        return self.nodes.filter(~F.col("kind").isin(S.FILE, S.EXTERNAL))

    def nodes_of_file(self, file: str) -> DataFrame:
        return self.symbols().filter(F.col("file") == file)

    def find(self, name: str) -> DataFrame:
        """All nodes of that short name, whatever its case."""
        return self.nodes.filter(F.lower("name") == F.lower(F.lit(name)))

    def autocomplete(self, text: str, most: int = 40) -> DataFrame:
        """The first ``most`` nodes whose name or id holds ``text``, whatever its case; by name, then id."""
        q = F.lower(F.lit(text))
        hit = F.lower("name").contains(q) | F.lower("node_id").contains(q)
        return self.nodes.filter(hit).orderBy("name", "node_id").limit(most)

    def ghosts(self) -> DataFrame:
        """``node_id`` of the ends of edges that have no row in ``nodes``."""
        ends = self.edges.select(F.col("src").alias("node_id")).unionByName(self.edges.select(F.col("tgt").alias("node_id"))).distinct()
        return ends.join(self.nodes.select("node_id"), "node_id", "left_anti")

    def with_externals(self) -> CodeGraph:
        """Rows for the ends of edges that name an external module; other ghosts stay ghosts."""
        ext = self.ghosts().filter(F.col("node_id").startswith(S.EXTERNAL_PREFIX) & ~F.col("node_id").startswith(S.UNRESOLVED_PREFIX))
        name = F.substring("node_id", len(S.EXTERNAL_PREFIX) + 1, 1 << 30)
        rows = ext.select("node_id", F.lit(S.EXTERNAL).alias("kind"), name.alias("name"), name.alias("qualified"))
        return CodeGraph(self.nodes.unionByName(conform_nodes(rows)), self.edges)

    # Set operations

    def upsert_nodes(self, new: DataFrame, order: str | None = None) -> CodeGraph:
        """``new`` rows replace those of the same id; among ``new`` ones the last by ``order`` wins."""
        if order is not None:
            last = Window.partitionBy("node_id").orderBy(F.desc(order))
            new = new.withColumn("__n", F.row_number().over(last)).filter("__n = 1")
        new = conform_nodes(new)
        return CodeGraph(self.nodes.join(new.select("node_id"), "node_id", "left_anti").select(*S.NODE_COLUMNS).unionByName(new), self.edges)

    def add_edges(self, new: DataFrame) -> CodeGraph:
        return CodeGraph(self.nodes, self.edges.unionByName(new.select(*S.EDGE_COLUMNS)))

    def remove_files(self, files: DataFrame) -> CodeGraph:
        """Without the nodes of ``files`` (column ``path``) and every edge that touches one; unknown files change nothing."""
        gone = self.nodes.join(files.select(F.col("path").alias("file")).distinct(), "file", "left_semi").select("node_id")
        gone, edges = small(stash(gone, "gone")), self.edges
        for end in ("src", "tgt"):
            edges = edges.join(gone.withColumnRenamed("node_id", end), end, "left_anti")
        return CodeGraph(self.nodes.join(gone, "node_id", "left_anti").select(*S.NODE_COLUMNS), edges.select(*S.EDGE_COLUMNS))

    # Statistics

    def by_kind(self) -> DataFrame:
        return self.nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))

    def by_language(self) -> DataFrame:
        return self.nodes.filter(scalar.strip(F.coalesce("language", F.lit(""))) != "").groupBy("language").agg(F.count(F.lit(1)).alias("n"))

    def by_edge(self) -> DataFrame:
        return self.edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))

    def totals(self) -> DataFrame:
        """One row: ``total_nodes`` (rows), ``total_edges`` (as a bag), ``total_ghosts``, ``total_files``.

        One aggregation by id: each edge counts for its source once, and both its ends are ghosts if no node has their id.
        """
        none = F.lit(0)
        nodes = self.nodes.select("node_id", F.lit(1).alias("n"), (F.col("kind") == S.FILE).cast("int").alias("f"), none.alias("e"))
        ends = F.explode(F.array(F.struct(F.col("src").alias("node_id"), F.lit(1).alias("e")), F.struct(F.col("tgt").alias("node_id"), none.alias("e")))).alias("x")
        edges = self.edges.select(ends).select("x.node_id", none.alias("n"), none.alias("f"), "x.e")
        by_id = nodes.unionByName(edges).groupBy("node_id").agg(F.sum("n").alias("n"), F.sum("f").alias("f"), F.sum("e").alias("e"))
        total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
        return by_id.agg(total("n", "total_nodes"), total("f", "total_files"), total("e", "total_edges"), F.count_if(F.col("n") == 0).alias("total_ghosts"))

    # Storage

    def save(self, path: str) -> None:
        """Two Parquet tables, both partitioned by kind, so that a look-up reads its kind only.

        Kinds are few: a task keeps a file open for each, in place of sorting its rows by kind.
        """
        conf, writers = self.nodes.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
        before = conf.get(writers)
        conf.set(writers, max(len(S.NODE_KINDS), int(before)))
        try:
            self.nodes.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/nodes")
            self.edges.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/edges")
        finally:
            conf.set(writers, before)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CodeGraph:
        return cls.of(spark.read.schema(S.NODE_SCHEMA).parquet(f"{path}/nodes"), spark.read.schema(S.EDGE_SCHEMA).parquet(f"{path}/edges"))

    def to_json_lines(self) -> DataFrame:
        """``kind_of_row`` and ``value``: a JSON object for every node and link."""
        nodes = self.nodes.select(F.lit("node").alias("kind_of_row"), F.to_json(F.struct(F.col("node_id").alias("id"), *[c for c in S.NODE_COLUMNS if c != "node_id"])).alias("value"))
        links = self.edges.select(F.lit("link").alias("kind_of_row"), F.to_json(F.struct(F.col("src").alias("source"), F.col("tgt").alias("target"), "kind")).alias("value"))
        return nodes.unionByName(links)

    def save_json(self, path: str) -> None:
        self.to_json_lines().write.mode("overwrite").partitionBy("kind_of_row").text(path)

    @classmethod
    def load_json(cls, spark: SparkSession, path: str) -> CodeGraph:
        """What ``save_json`` wrote, or a single node-link document ``{"nodes": [...], "links": [...]}``."""
        fields = [f for f in S.NODE_SCHEMA.fields if f.name != "node_id"]
        node = "struct<id:string," + ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in fields) + ">"
        link = "struct<source:string,target:string,kind:string>"
        hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = hpath.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.getFileStatus(hpath).isDirectory():
            lines = spark.read.schema("value string, kind_of_row string").text(path)
            n = lines.filter("kind_of_row = 'node'").select(F.from_json("value", node).alias("x"))
            e = lines.filter("kind_of_row = 'link'").select(F.from_json("value", link).alias("x"))
        else:
            doc = spark.read.text(path, wholetext=True).select(F.from_json("value", f"struct<nodes:array<{node}>,links:array<{link}>>").alias("d"))
            n, e = doc.select(F.explode("d.nodes").alias("x")), doc.select(F.explode("d.links").alias("x"))
        nodes = n.select(F.col("x.id").alias("node_id"), *[F.col(f"x.{f.name}") for f in fields])
        return cls.of(nodes, e.select(F.col("x.source").alias("src"), F.col("x.target").alias("tgt"), "x.kind"))
