"""One-hop look-ups, for one subject, for a table of subjects or for all at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import scalar
from ..graph import CodeGraph
from ..storage import spread

#: Operator to (edge kind, whether the answer is the edges' source).
LOOKUPS = {
    "callers": (S.CALLS, True),
    "callees": (S.CALLS, False),
    "subclasses": (S.INHERITS, True),
    "superclasses": (S.INHERITS, False),
    "implementors": (S.IMPLEMENTS, True),
    "imports_of": (S.IMPORTS, False),
}

Subjects = str | list[str] | DataFrame | None


def subject_table(spark: SparkSession, subjects: str | list[str]) -> DataFrame:
    return spark.createDataFrame([(x,) for x in ([subjects] if isinstance(subjects, str) else subjects)], "subject string")


def look_up(graph: CodeGraph, operator: str, subjects: Subjects = None) -> DataFrame:
    """``subject`` and the distinct nodes one edge away from it.

    ``subjects`` is an id, a list of ids, a DataFrame with a column ``subject``, or None for every subject that has
    such an edge. Ids that the graph lacks have no answer. External modules are nodes; other ends of edges
    without a row are left out.
    """
    kind, incoming = LOOKUPS[operator]
    here, there = ("tgt", "src") if incoming else ("src", "tgt")
    pairs = graph.edges.filter(F.col("kind") == kind).select(F.col(here).alias("subject"), F.col(there).alias("node_id"))
    if isinstance(subjects, str):
        pairs = pairs.filter(F.col("subject") == subjects)
    elif isinstance(subjects, list):
        pairs = pairs.filter(F.col("subject").isin(subjects))
    elif subjects is not None:
        pairs = pairs.join(subjects.select("subject"), "subject", "left_semi")
    else:
        pairs = spread(pairs, pairs.count(), "node_id")  # one exchange for this and for the join
    pairs = pairs.distinct()
    nodes = graph.with_externals().nodes if operator == "imports_of" else graph.nodes
    return pairs.join(nodes, "node_id").select("subject", *S.NODE_COLUMNS)


def callers(graph: CodeGraph, subjects: Subjects = None) -> DataFrame:
    return look_up(graph, "callers", subjects)


def callees(graph: CodeGraph, subjects: Subjects = None) -> DataFrame:
    return look_up(graph, "callees", subjects)


def subclasses(graph: CodeGraph, subjects: Subjects = None) -> DataFrame:
    """Direct subclasses only."""
    return look_up(graph, "subclasses", subjects)


def superclasses(graph: CodeGraph, subjects: Subjects = None) -> DataFrame:
    """Direct superclasses only."""
    return look_up(graph, "superclasses", subjects)


def implementors(graph: CodeGraph, subjects: Subjects = None) -> DataFrame:
    return look_up(graph, "implementors", subjects)


def imports_of(graph: CodeGraph, subjects: Subjects = None) -> DataFrame:
    return look_up(graph, "imports_of", subjects)


def find_symbols(graph: CodeGraph, names: DataFrame | str) -> DataFrame:
    """``subject`` (the name asked for) and every node of that short name, whatever its case; ``names`` has ``subject``."""
    if isinstance(names, str):
        names = subject_table(graph.nodes.sparkSession, names)
    asked = names.select("subject", F.lower("subject").alias("__key")).distinct()
    return graph.nodes.withColumn("__key", F.lower("name")).join(asked, "__key").select("subject", *S.NODE_COLUMNS)


def messages(found: DataFrame, operator: str, subjects: DataFrame) -> DataFrame:
    """``subject``, ``n`` and ``message`` for every subject, those without an answer included."""
    n = found.groupBy("subject").agg(F.count(F.lit(1)).alias("n"))
    all_ = subjects.select("subject").distinct().join(n, "subject", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return all_.withColumn("message", scalar.message(operator, F.col("n"), F.col("subject")))


def node_detail(graph: CodeGraph, node_id: str) -> DataFrame:
    """One row with the node and slim ``callers`` and ``callees``; no row for an unknown id."""
    slim = F.struct("node_id", "name", "kind", "file", "line", "language")
    near = lambda op: look_up(graph, op, node_id).groupBy("subject").agg(F.array_sort(F.collect_list(slim)).alias(op)).withColumnRenamed("subject", "node_id")
    return graph.node(node_id).join(near("callers"), "node_id", "left").join(near("callees"), "node_id", "left")
