"""Aggregated views of the graph for display: flows between files, trees, folders, element lists."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import scalar
from ..graph import CodeGraph
from ..storage import spread, stash

#: Order of kinds among the children of one parent.
KIND_ORDER = (S.CLASS, S.INTERFACE, S.STRUCT, S.ENUM, S.TRAIT, S.FUNCTION, S.METHOD, S.FILE, S.EXTERNAL)


def flow_edges(graph: CodeGraph) -> DataFrame:
    """``source``, ``target``, ``weight``: how many calls go from one file to another; parallel calls all count."""
    files = graph.nodes.filter(F.coalesce("file", F.lit("")) != "").select("node_id", "file")
    calls = graph.edges.filter(F.col("kind") == S.CALLS).select("src", "tgt")
    rows = calls.count()
    # calls hardly repeat, so that counting them first would be one more exchange of all of them
    begun = spread(calls, rows, "src").join(files.toDF("src", "source"), "src").select("source", "tgt")
    ends = spread(begun, rows, "tgt").join(files.toDF("tgt", "target"), "tgt")
    return ends.filter("source <> target").groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight"))


def flow_nodes(graph: CodeGraph, flows: DataFrame | None = None) -> DataFrame:
    """Every file: ``id``, ``label``, ``language``, ``in_degree`` and ``out_degree`` (distinct files), ``symbol_count``, ``radius``."""
    flows = stash(flow_edges(graph) if flows is None else flows, "flows")
    files = graph.nodes.filter(F.col("kind") == S.FILE).select(F.col("node_id").alias("id"), F.col("language").alias("lang"))
    ends = flows.select(F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(flows.select(F.col("source").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    degree = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    symbols = graph.nodes.filter(F.col("kind").isin(S.FUNCTION, S.METHOD, S.CLASS)).groupBy(F.col("file").alias("id")).agg(F.count(F.lit(1)).alias("symbol_count"))
    all_ = files.join(degree, "id", "full_outer").join(symbols, "id", "left")
    n = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    out = all_.select("id", scalar.base_name(F.col("id")).alias("label"), scalar.language_of(F.col("id"), F.coalesce("lang", F.lit(""))).alias("language"), n("in_degree"), n("out_degree"), n("symbol_count"))
    return out.withColumn("radius", scalar.radius(F.col("in_degree")))


def flow_symbols(graph: CodeGraph) -> DataFrame:
    """The symbols of each file with their place ``ord`` (from 0) by line, then id."""
    inside = Window.partitionBy("file").orderBy("line", "node_id")
    return graph.symbols().select("file", (F.row_number().over(inside) - 1).alias("ord"), "node_id", "name", "kind", "line")


def flow_links(graph: CodeGraph, symbols: DataFrame | None = None) -> DataFrame:
    """``file``, ``s``, ``t``: distinct calls inside a file by the symbols' places, none to itself."""
    symbols = flow_symbols(graph) if symbols is None else symbols
    places = symbols.select("node_id", "file", "ord")
    calls = graph.edges.filter((F.col("kind") == S.CALLS) & (F.col("src") != F.col("tgt"))).select("src", "tgt")
    rows = calls.count()
    a, b = places.toDF("src", "file", "s"), places.toDF("tgt", "file", "t")
    begun = spread(calls, rows, "src").join(a, "src").select("file", "s", "tgt")
    return spread(begun, rows, "tgt", "file").join(b, ["tgt", "file"]).select("file", "s", "t").distinct()


def children_summary(graph: CodeGraph) -> DataFrame:
    """``parent`` and ``summary``, such as "1 class, 2 functions", kinds in order of name."""
    kids = graph.edges.filter(F.col("kind").isin(S.DEFINES, S.CONTAINS)).select(F.col("src").alias("parent"), F.col("tgt").alias("node_id"))
    counts = kids.join(graph.nodes.select("node_id", "kind"), "node_id").groupBy("parent", "kind").agg(F.count(F.lit(1)).alias("n"))
    text = F.concat(F.col("n").cast("string"), F.lit(" "), "kind", F.when(F.col("n") > 1, "s").otherwise(""))
    parts = F.array_sort(F.collect_list(F.struct("kind", text.alias("text"))))
    return counts.groupBy("parent").agg(F.array_join(F.transform(parts, lambda x: x["text"]), ", ").alias("summary"))


def tree_rows(graph: CodeGraph) -> DataFrame:
    """The containment tree as rows: ``file``, ``depth``, ``parent``, ``node_id``, ``kind``, ``name``, ``line``, ``pos``.

    ``pos`` (from 0) is the place among the parent's children by kind, line and id. Children without a row are of kind
    ``unknown``. A file's symbols are at depth 1, what they contain is at depth 2.
    """
    order = F.coalesce(F.try_element_at(F.create_map(*[x for i, k in enumerate(KIND_ORDER) for x in (F.lit(k), F.lit(i))]), F.col("kind")), F.lit(99))
    links = graph.edges.filter(F.col("kind").isin(S.DEFINES, S.CONTAINS)).select(F.col("kind").alias("link"), F.col("src").alias("parent"), F.col("tgt").alias("node_id")).distinct()
    info = graph.nodes.select("node_id", "kind", "name", "line")
    kids = links.join(info, "node_id", "left").select(
        "parent", "node_id", F.coalesce("kind", F.lit("unknown")).alias("kind"), F.coalesce("name", "node_id").alias("name"), F.coalesce("line", F.lit(0)).alias("line"), "link"
    )
    files = graph.nodes.filter(F.col("kind") == S.FILE).select(F.col("node_id").alias("file"))
    one = kids.filter(F.col("link") == S.DEFINES).join(files.withColumnRenamed("file", "parent"), "parent", "left_semi").withColumn("file", F.col("parent"))
    two = kids.filter(F.col("link") == S.CONTAINS).join(one.select(F.col("node_id").alias("parent"), "file"), "parent")
    cols = ["file", "parent", "node_id", "kind", "name", "line"]
    rows = one.select(*cols, F.lit(1).alias("depth")).unionByName(two.select(*cols, F.lit(2).alias("depth")))
    place = Window.partitionBy("file", "parent").orderBy(order, "line", "node_id")
    top = files.join(graph.nodes, files["file"] == F.col("node_id")).select(files["file"], F.lit(None).cast("string").alias("parent"), "node_id", "kind", "name", "line", F.lit(0).alias("depth"), F.lit(0).alias("pos"))
    return top.unionByName(rows.withColumn("pos", F.row_number().over(place) - 1))


def folder_rows(files: DataFrame) -> DataFrame:
    """``folder``, ``parent``, ``label``, ``n_files``: the directories of ``path`` with chains of single ones joined.

    A directory without files and with exactly one directory below it is part of that one's label. Parents are whole paths, '' at the top.
    """
    dirs = files.select(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1).alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    dirs = dirs.filter(F.size("d") > 0)
    prefix = F.explode(F.transform(F.sequence(F.lit(1), F.size("d")), lambda i: F.struct(F.array_join(F.slice("d", 1, i), "/").alias("folder"), F.array_join(F.slice("d", 1, i - 1), "/").alias("up"), F.when(i == F.size("d"), F.col("n")).otherwise(0).alias("n"))))
    every = dirs.select(prefix.alias("x")).select("x.*").groupBy("folder", "up").agg(F.sum("n").alias("n_files"))
    below = every.groupBy(F.col("up").alias("folder")).agg(F.count(F.lit(1)).alias("n_below"))
    kept = every.join(below, "folder", "left").filter((F.col("n_files") > 0) | (F.coalesce("n_below", F.lit(0)) != 1)).select("folder", "n_files")
    parts = F.split("folder", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    near = kept.select("folder", "n_files", F.explode(ups).alias("up")).join(kept.select(F.col("folder").alias("up"), F.lit(True).alias("k")), "up", "left")
    last = F.max(F.when(F.col("k"), F.struct(F.length("up").alias("n"), F.col("up").alias("u"))))["u"]
    up = near.groupBy("folder", "n_files").agg(F.coalesce(last, F.lit("")).alias("parent"))
    label = F.when(F.col("parent") == "", F.col("folder")).otherwise(F.expr("substring(folder, length(parent) + 2)"))
    return up.select("folder", "parent", label.alias("label"), "n_files")


def edge_elements(graph: CodeGraph) -> DataFrame:
    """``id``, ``source``, ``target``, ``kind``: every edge; parallel ones get ``_1``, ``_2`` and so on behind their id."""
    same = Window.partitionBy("src", "kind", "tgt").orderBy("src")
    n = F.row_number().over(same) - 1
    return graph.edges.select(_element_id(n).alias("id"), F.col("src").alias("source"), F.col("tgt").alias("target"), "kind")


def _element_id(n: Column) -> Column:
    """The id of an edge that is the ``n``-th of its parallel ones, from 0."""
    return F.concat(F.concat_ws("--", "src", "kind", "tgt"), F.when(n > 0, F.concat(F.lit("_"), n.cast("string"))).otherwise(""))


def node_elements(graph: CodeGraph) -> DataFrame:
    """Slim rows: ``id``, ``label``, ``kind``, ``language``, ``file``, ``line``, ``classes``."""
    classes = F.concat(F.lit("kind-"), "kind", F.when(F.col("kind") == S.EXTERNAL, " external").otherwise(""))
    return graph.nodes.select(F.col("node_id").alias("id"), F.col("name").alias("label"), "kind", "language", "file", "line", classes.alias("classes"))


def node_details(graph: CodeGraph) -> DataFrame:
    return graph.nodes.select(F.col("node_id").alias("id"), "end_line", "qualified", "docstring", "signature", "is_async", "decorators")


def node_bodies(graph: CodeGraph) -> DataFrame:
    return graph.nodes.filter(scalar.strip(F.col("body")) != "").select(F.col("node_id").alias("id"), "body")


def edges_by_kind(graph: CodeGraph, most: int = 10_000) -> DataFrame:
    """``kind``, ``part`` and ``edges``, its elements in order of id; a kind of more than ``most`` elements, on average, is in several parts."""
    kinds = stash(graph.edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n")), "kinds")
    parts = F.broadcast(kinds.select("kind", F.ceil(F.col("n") / F.lit(most)).alias("parts")))  # kinds are few
    rows = kinds.agg(F.sum("n")).first()[0] or 0
    # parallel edges meet in one part, so that one exchange does for numbering and gathering; ``most`` and more of them go to parts of their own
    placed = graph.edges.join(parts, "kind").withColumn("part", F.pmod(F.xxhash64("src", "tgt"), F.col("parts")))
    same = Window.partitionBy("kind", "part", "src", "tgt").orderBy("src")
    numbered = spread(placed, rows, "kind", "part").withColumn("n", F.row_number().over(same) - 1)
    apart = (F.col("part") + F.col("parts") * F.floor(F.col("n") / F.lit(most)))
    elements = numbered.select("kind", "part", apart.alias("__part"), _element_id(F.col("n")).alias("id"), F.col("src").alias("source"), F.col("tgt").alias("target"))
    lists = elements.groupBy("kind", "part", "__part").agg(F.array_sort(F.collect_list(F.struct("id", "source", "target"))).alias("edges"))
    return lists.select("kind", F.col("__part").alias("part"), "edges")


def file_panel(flows: DataFrame, most: int = 30) -> DataFrame:
    """``file``, ``callers``, ``callees``: the files that call it and that it calls, heaviest first, at most ``most``, and how many more."""

    flows = stash(flows.select("source", "target", "weight"), "flows")

    def side(here: str, there: str, name: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(here).orderBy(F.desc("weight"), there))
        first = flows.withColumn("n", place).filter(F.col("n") <= most).groupBy(F.col(here).alias("file")).agg(F.array_sort(F.collect_list(F.struct("n", F.col(there).alias("f")))).alias("first"))
        rest = F.col("all") - most
        shown = F.array_join(F.transform("first", lambda x: x["f"]), ", ")
        count = flows.groupBy(F.col(here).alias("file")).agg(F.count(F.lit(1)).alias("all"))
        return first.join(count, "file").select("file", F.concat(shown, F.when(rest > 0, F.concat(F.lit(" … and "), rest.cast("string"), F.lit(" more"))).otherwise("")).alias(name))

    return side("target", "source", "callers").join(side("source", "target", "callees"), "file", "full_outer")


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.toLocalIterator()]


def export_flow(graph: CodeGraph) -> dict:
    """The two-level flow view as plain data, for a page: its size follows files and calls between them."""
    flows = flow_edges(graph)
    nodes, edges = _rows(flow_nodes(graph, flows).orderBy("id")), _rows(flows.orderBy(F.desc("weight"), "source", "target"))
    inside: dict[str, dict] = {}
    for r in _rows(flow_symbols(graph).orderBy("file", "ord")):
        inside.setdefault(r["file"], {"nodes": [], "edges": []})["nodes"].append({k: r[k] for k in ("node_id", "name", "kind", "line")})
    for r in _rows(flow_links(graph).orderBy("file", "s", "t")):
        inside[r["file"]]["edges"].append([r["s"], r["t"]])
    return {"level1": {"nodes": nodes, "edges": edges}, "level2": inside, "stats": {"file_count": len(nodes), "edge_count": len(edges), "node_count": sum(len(x["nodes"]) for x in inside.values())}}


def export_elements(graph: CodeGraph) -> dict:
    """Nodes, details, bodies and edges by kind as plain data."""
    nodes = _rows(node_elements(graph).orderBy("id"))
    detail = {r.pop("id"): r for r in _rows(node_details(graph))}
    bodies = {r["id"]: r["body"] for r in _rows(node_bodies(graph))}
    edges: dict[str, list] = {}
    for r in _rows(edge_elements(graph).orderBy("id")):
        edges.setdefault(r.pop("kind"), []).append(r)
    stats = {"node_count": len(nodes), "edge_count": sum(map(len, edges.values())), "file_count": sum(n["kind"] == S.FILE for n in nodes)}
    return dict(stats=stats, nodes=nodes, edges_by_kind=edges, bodies=bodies, detail=detail)


def export_tree(graph: CodeGraph) -> dict:
    """Folders, tree rows and details (end line and children) as plain data."""
    files = graph.nodes.filter(F.col("kind") == S.FILE).select(F.col("node_id").alias("path"))
    detail = graph.nodes.filter(F.col("kind") != S.EXTERNAL).select(F.col("node_id").alias("parent"), "end_line").join(children_summary(graph), "parent", "left")
    return {"folders": _rows(folder_rows(files).orderBy("folder")), "tree": _rows(tree_rows(graph).orderBy("file", "depth", "parent", "pos")), "detail": {r.pop("parent"): r for r in _rows(detail)}}


def to_json(data: dict) -> str:
    return json.dumps(data, ensure_ascii=False, separators=(",", ":")).replace("</", "<\\/")
