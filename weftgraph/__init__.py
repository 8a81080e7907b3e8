"""Code-graph analytics and training-data operators on Spark."""

from .config import Config
from .engine import BuildReport, Index, LookUp
from .graph import CodeGraph
from .operators.exports import export_elements, export_flow, export_tree
from .operators.structural import callees, callers, find_symbols, implementors, imports_of, look_up, subclasses, superclasses
from .operators.traversal import bfs, call_chain, induced, k_hop
from .operators.vector import CellIndex, embed, explain, search, top_k, top_k_all
from .sources.files import parse, scan
from .sources.parsers import parse_source

__all__ = [
    "BuildReport", "CellIndex", "CodeGraph", "Config", "Index", "LookUp", "bfs", "call_chain", "callees", "callers", "embed", "explain", "export_elements", "export_flow", "export_tree",
    "find_symbols", "implementors", "imports_of", "induced", "k_hop", "look_up", "parse", "parse_source", "scan", "search", "subclasses", "superclasses", "top_k", "top_k_all",
]
