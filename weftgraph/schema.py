"""Schemas and vocabularies of the code graph: two DataFrames, ``nodes`` and ``edges``."""

from __future__ import annotations

from pyspark.sql import types as T

NODE_KINDS = "class enum external file function interface method struct trait".split()
CLASS, ENUM, EXTERNAL, FILE, FUNCTION, INTERFACE, METHOD, STRUCT, TRAIT = NODE_KINDS
EDGE_KINDS = "CALLS CONTAINS DEFINES IMPLEMENTS IMPORTS INHERITS".split()
CALLS, CONTAINS, DEFINES, IMPLEMENTS, IMPORTS, INHERITS = EDGE_KINDS

EXTERNAL_PREFIX = "ext::"
UNRESOLVED_PREFIX = "ext::__unresolved__::"

NODE_SCHEMA = T.StructType(
    [
        T.StructField("node_id", T.StringType(), False),
        T.StructField("kind", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("qualified", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("language", T.StringType()),
        T.StructField("docstring", T.StringType()),
        T.StructField("signature", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("is_async", T.BooleanType()),
        T.StructField("decorators", T.ArrayType(T.StringType())),
    ]
)
EDGE_SCHEMA = T.StructType([T.StructField(c, T.StringType(), False) for c in ("src", "tgt", "kind")])
STATE_SCHEMA = T.StructType([T.StructField("path", T.StringType()), T.StructField("mtime", T.DoubleType()), T.StructField("sha256", T.StringType())])
VECTOR_SCHEMA = T.StructType([T.StructField("node_id", T.StringType()), T.StructField("document", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
NODE_COLUMNS, EDGE_COLUMNS = NODE_SCHEMA.fieldNames(), EDGE_SCHEMA.fieldNames()

#: What a field of a node is where a source does not give it.
DEFAULTS = {"line": 0, "end_line": 0, "is_async": False}
