"""Change detection and the incremental merge of parse results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..graph import CodeGraph


def diff_files(current: DataFrame, stored: DataFrame, content_only: bool = False) -> DataFrame:
    """``path`` and ``status``: new, changed, unchanged or deleted.

    Both sides have (path, mtime, sha256). A file has changed when its hash differs or, without ``content_only``, its
    time. Null times or hashes are equal to null only.
    """
    a, b = current.alias("a"), stored.alias("b")
    differs = ~F.col("a.sha256").eqNullSafe(F.col("b.sha256"))
    if not content_only:
        differs = differs | ~F.col("a.mtime").eqNullSafe(F.col("b.mtime"))
    status = F.when(F.col("b.path").isNull(), "new").when(F.col("a.path").isNull(), "deleted").when(differs, "changed").otherwise("unchanged")
    return a.join(b, F.col("a.path") == F.col("b.path"), "full_outer").select(F.coalesce("a.path", "b.path").alias("path"), status.alias("status"))


def file_nodes(files: DataFrame) -> DataFrame:
    """A FILE node for each (path, language)."""
    return files.select(F.col("path").alias("node_id"), F.lit(S.FILE).alias("kind"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("path").alias("qualified"), F.col("path").alias("file"), "language")


def defines_edges(nodes: DataFrame) -> DataFrame:
    """DEFINES from each file to its symbols but methods, once each."""
    top = nodes.filter(F.col("kind").isin(S.FUNCTION, S.CLASS, S.INTERFACE, S.STRUCT, S.ENUM, S.TRAIT))
    return top.select(F.col("file").alias("src"), F.col("node_id").alias("tgt"), F.lit(S.DEFINES).alias("kind")).distinct()


def integrate(graph: CodeGraph, nodes: DataFrame, edges: DataFrame, files: DataFrame) -> CodeGraph:
    """The graph with parsed rows in place of what it had for their files.

    ``nodes`` has the node fields and ``ordinal`` (the last of one id wins), ``edges`` is a bag whose CONTAINS rows count once,
    ``files`` has (path, language).
    """
    kept = graph.remove_files(files)
    once = edges.filter(F.col("kind") == S.CONTAINS).distinct().unionByName(edges.filter(F.col("kind") != S.CONTAINS))
    return kept.upsert_nodes(nodes, "ordinal").upsert_nodes(file_nodes(files)).add_edges(once.select(*S.EDGE_COLUMNS)).add_edges(defines_edges(nodes))
