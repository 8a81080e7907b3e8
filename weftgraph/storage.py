"""Tables in the folder that all executors share, which cut the lineage and outlive a lost executor."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a counted side that is broadcast at most, and of a shuffle's task on average at most.
BROADCAST_ROWS, TASK_ROWS = 1_000_000, 500_000

_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session without it gets a folder of its own, a cluster must name one."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _local.append(tempfile.mkdtemp(prefix="weftgraph-"))
        sc.setCheckpointDir("file://" + _local[-1])
        where = sc.getCheckpointDir()
    return where.rstrip("/")


_made: dict[str, list[str]] = {}


def sweep(spark: SparkSession) -> int:
    """Deletes all tables that this application has put into the shared folder, once its results are written; how many there were.

    Frames that were not written yet can't be read any more. What is left is swept when the process ends, if Spark still runs.
    """
    paths = _made.pop(spark.sparkContext.applicationId, [])
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)


@atexit.register
def _sweep() -> None:
    spark = SparkSession.getActiveSession() if _made else None
    if spark is not None:
        with contextlib.suppress(Exception):  # the session may have been stopped
            sweep(spark)
    for d in _local:
        shutil.rmtree(d, ignore_errors=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted by ``sweep``."""
    path = f"{shared_folder(spark)}/weftgraph/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def is_kept(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is one of this application's, not swept yet."""
    return path in _made.get(spark.sparkContext.applicationId, ())


def stash(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read again."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if it has no more than BROADCAST_ROWS rows. It is counted, so it should be stored or cheap."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` exchanged by ``keys`` into as many partitions as ``rows`` call for, the number of its rows.

    Narrow rows take much more memory in a task than in the exchange, whose size adaptive execution goes by.
    """
    least, n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS)
    return df.repartition(max(n, least), *keys) if n > 1 else df.repartition(*keys)
