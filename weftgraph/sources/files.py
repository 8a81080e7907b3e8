"""Source trees as tables: directory scan with hashes, the parsers as a table function, the stored file state."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import scalar
from ..session import ship
from .parsers import OUT_SCHEMA, parse_source, supported_extensions


def scan(spark: SparkSession, root: str, exclude: Iterable[str] = (), extensions: Iterable[str] | None = None) -> DataFrame:
    """``path`` (below ``root``), ``mtime``, ``sha256``, ``language``, ``content`` of all source files that no pattern excludes.

    ``root`` is a folder of any file system that Spark reads. An empty folder gives no rows. Spark's file sources leave out files of
    no bytes; those are listed by the driver and added.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    base = fs.resolvePath(hadoop).toUri().getPath()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    plain = F.regexp_replace("path", r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?(?=/)", "")
    path = scalar.relative_path(plain, base)
    known = list(extensions) if extensions is not None else supported_extensions()
    # the test of the extension comes first: it is cheaper than the patterns
    files = files.select("path", "modificationTime", "content").unionByName(_empty_files(spark, fs, hadoop))
    some = files.select(path.alias("path"), "modificationTime", "content").filter(scalar.suffix(F.col("path")).isin(known)).filter(~scalar.excluded(F.col("path"), exclude))
    return some.select("path", (F.unix_micros("modificationTime") / 1e6).alias("mtime"), F.sha2("content", 256).alias("sha256"), scalar.language_of(F.col("path")).alias("language"), "content")


def _empty_files(spark: SparkSession, fs, root) -> DataFrame:
    """``path``, ``modificationTime`` and empty ``content`` of the files of no bytes, which are few."""
    found, listed = [], fs.listFiles(root, True)
    while listed.hasNext():
        f = listed.next()
        if f.getLen() == 0:
            found.append((f.getPath().toUri().getPath(), f.getModificationTime()))
    rows = spark.createDataFrame(found, "path string, millis bigint")
    return rows.select("path", F.timestamp_millis("millis").alias("modificationTime"), F.lit(b"").alias("content"))


def parse(files: DataFrame, options: dict | None = None) -> DataFrame:
    """Rows of OUT_SCHEMA for (path, content or text): ``rec_type`` tells nodes, edges and errors apart.

    Bytes that are no UTF-8 are replaced. Null content gives an error row.
    """
    ship(files.sparkSession)
    text = F.col("text") if "text" in files.columns else F.make_valid_utf8(F.col("content").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [t for p, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for t in parse_source(p, s, options).tuples()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

    return files.select("path", text.alias("text")).mapInArrow(run, OUT_SCHEMA)


_ARROW = pa.schema([
    (name, {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}[kind]) for name, kind in (x.split() for x in OUT_SCHEMA.split(", "))
])


def nodes_of(parsed: DataFrame) -> DataFrame:
    return parsed.filter("rec_type = 'node'").select(*S.NODE_COLUMNS, "ordinal")


def edges_of(parsed: DataFrame) -> DataFrame:
    return parsed.filter("rec_type = 'edge'").select("src", "tgt", F.col("edge_kind").alias("kind"))


def errors_of(parsed: DataFrame) -> DataFrame:
    return parsed.filter("rec_type = 'error'").select("file", "message")


def register_sql(spark: SparkSession) -> None:
    """The SQL table function ``parse_source(path, text)``: ``SELECT p.* FROM files, LATERAL parse_source(path, text) p``."""
    ship(spark)
    from pyspark.sql.functions import udtf

    @udtf(returnType=OUT_SCHEMA)
    class ParseSource:
        def eval(self, path: str, text: str):
            yield from parse_source(path, text).tuples()

    spark.udtf.register("parse_source", ParseSource)


def load_state(spark: SparkSession, path: str) -> DataFrame:
    """The stored (path, mtime, sha256); empty where none is stored or what is stored cannot be read, so that all files count as new."""
    try:
        state = spark.read.schema(S.STATE_SCHEMA).parquet(path)
        state.agg(F.max(F.struct(*state.columns))).collect()  # reads all columns of all rows: a corrupt file shows here
    except (PySparkException, Py4JJavaError):
        return spark.createDataFrame([], S.STATE_SCHEMA)
    return state


def save_state(files: DataFrame, path: str) -> None:
    files.select("path", "mtime", "sha256").write.mode("overwrite").parquet(path)
