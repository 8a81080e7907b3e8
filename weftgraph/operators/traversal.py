"""Traversals by levels. Every level is one job whose result is a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..graph import CodeGraph
from ..storage import stash


def _next(frontier: DataFrame, links: DataFrame, paths: bool) -> DataFrame:
    """Nodes one link on, with ``paths`` each with the smallest path that leads there."""
    if not paths:
        return links.join(frontier.select(F.col("node_id").alias("src")), "src", "left_semi").select(F.col("tgt").alias("node_id")).distinct()
    step = frontier.join(links, frontier["node_id"] == links["src"]).groupBy("tgt").agg(F.min("path").alias("path"))
    return step.select(F.col("tgt").alias("node_id"), F.concat("path", F.array("tgt")).alias("path"))


def bfs(links: DataFrame, start: DataFrame, max_depth: int | None = None, target: str | None = None, paths: bool = True) -> DataFrame:
    """``node_id``, ``depth`` and, with ``paths``, ``path`` of all that ``start`` (column ``node_id``) reaches by ``links`` (src, tgt).

    ``path`` is the shortest one, of several the smallest in order of ids. Null ids reach nothing. It ends when a level is
    empty, at ``max_depth``, or once ``target`` is found.
    """
    links = stash(links.select("src", "tgt").filter("src <> tgt").distinct(), "links")
    cols = ["node_id", F.array("node_id").alias("path")] if paths else ["node_id"]
    level = stash(start.filter("node_id IS NOT NULL").select("node_id").distinct().select(*cols), "bfs-0")
    seen, depth = level.withColumn("depth", F.lit(0)), 0
    while max_depth is None or depth < max_depth:
        if target is not None and not level.filter(F.col("node_id") == target).isEmpty():
            break
        depth += 1
        level = stash(_next(level, links, paths).join(seen.select("node_id"), "node_id", "left_anti").select(*level.columns), f"bfs-{depth}")
        if level.isEmpty():
            break
        seen = seen.unionByName(level.withColumn("depth", F.lit(depth)))
    return seen


def call_chain(graph: CodeGraph, source: str, target: str, max_depth: int | None = None) -> DataFrame:
    """The nodes of the shortest chain of calls with their place ``pos``; none if there is none.

    Among chains of the same length the smallest in order of ids. From a node to itself the chain is that node,
    if it has any call.
    """
    calls = graph.edges.filter(F.col("kind") == S.CALLS)
    known = calls.filter((F.col("src") == source) | (F.col("tgt") == source)).limit(1)
    start = known.select(F.lit(source).alias("node_id"))
    found = bfs(calls, start, max_depth, target).filter(F.col("node_id") == target)
    steps = found.select(F.posexplode("path").alias("pos", "node_id"))
    return steps.join(graph.nodes, "node_id").select("pos", *S.NODE_COLUMNS)


def k_hop(graph: CodeGraph, seeds: DataFrame, hops: int = 1) -> DataFrame:
    """``node_id`` of all nodes within ``hops`` edges of any kind, in either direction; the seeds are kept."""
    seen = stash(seeds.select("node_id").distinct(), "hop-0")
    new = seen
    for hop in range(1, hops + 1):
        out = graph.edges.join(new.withColumnRenamed("node_id", "src"), "src", "left_semi").select(F.col("tgt").alias("node_id"))
        back = graph.edges.join(new.withColumnRenamed("node_id", "tgt"), "tgt", "left_semi").select(F.col("src").alias("node_id"))
        new = stash(out.unionByName(back).distinct().join(seen, "node_id", "left_anti"), f"hop-{hop}")
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
    return seen


def induced(graph: CodeGraph, ids: DataFrame) -> CodeGraph:
    """The nodes of ``ids`` and the edges with both ends among them."""
    ids = ids.select("node_id").distinct()
    edges = graph.edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "tgt"), "tgt", "left_semi")
    return CodeGraph(graph.nodes.join(ids, "node_id", "left_semi").select(*S.NODE_COLUMNS), edges.select(*S.EDGE_COLUMNS))
