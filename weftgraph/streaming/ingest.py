"""Structured Streaming over a folder that source files are dropped into."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import scalar
from ..graph import CodeGraph
from ..operators import incremental
from ..sources import files as src


def read_sources(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (path, text, language) of new files, whatever their depth."""
    lines = spark.readStream.option("wholetext", "true").option("recursiveFileLookup", "true").format("text").load(folder)
    path = F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?(?=/)", ""))
    rel = scalar.relative_path(path, folder.removeprefix("file://"))
    return lines.select(rel.alias("path"), F.col("value").alias("text")).withColumn("language", scalar.language_of(F.col("path"))).filter("language <> ''")


def ingest(spark: SparkSession, folder: str, store: str, checkpoint: str, options: dict | None = None) -> StreamingQuery:
    """Merge every batch of new files into the graph kept in ``store``; takes what is there and ends.

    Batch n writes ``store``/batch-n from the one before, so that a batch that is run again after a failure gives the same; the one
    before that is deleted.
    """

    def merge(batch: DataFrame, n: int) -> None:
        session = batch.sparkSession
        graph = CodeGraph.load(session, f"{store}/batch-{n - 1}") if n else CodeGraph.empty(session)
        files = batch.persist()
        parsed = src.parse(files, options).persist()
        incremental.integrate(graph, src.nodes_of(parsed), src.edges_of(parsed), files.select("path", "language")).save(f"{store}/batch-{n}")
        parsed.unpersist()
        files.unpersist()
        if n > 1:
            old = session._jvm.org.apache.hadoop.fs.Path(f"{store}/batch-{n - 2}")
            old.getFileSystem(session._jsc.hadoopConfiguration()).delete(old, True)

    return read_sources(spark, folder).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
