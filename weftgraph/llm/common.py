"""Helpers shared by the ten operators: column hygiene, shared storage, stable scans.

All operators take tables whose column names differ by case only or repeat: the first of them is meant.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_folder, stash

__all__ = ["buckets_for", "col", "lean", "mix", "pack40", "read", "stable", "stash", "tidy", "unpack40"]


_MMAP_THRESHOLD = -3  # mallopt's number for it


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a step over Arrow batches, in a worker that gives freed memory back: workers live on after a task."""

    def step(batches: Iterator) -> Iterator:
        libc = ctypes.CDLL(None)
        if hasattr(libc, "mallopt"):  # large arrays in pages of their own, whatever was freed before
            libc.mallopt(_MMAP_THRESHOLD, 4 << 20)
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(libc, "malloc_trim"):
                libc.malloc_trim(0)

    return step


def tidy(df: DataFrame, reserved: Iterable[str] = (), keep: Iterable[str] = ()) -> DataFrame:
    """Give every column a unique name that is not reserved by the operator's output.

    Spark compares names without case, so does this. The first column of a name listed in
    ``keep`` (the operator's inputs) keeps it; any other column that repeats a name or has a
    reserved one is renamed to ``<name>_in``, ``<name>_in_in`` and so on. No data is lost.
    """
    taken = {r.lower() for r in reserved}
    keep_names = {k.lower() for k in keep}
    seen: set[str] = set()
    names: list[str] = []
    present = {c.lower() for c in df.columns}
    for c in df.columns:
        name = c
        clash = name.lower() in seen or (name.lower() in taken and name.lower() not in keep_names)
        while clash:
            name += "_in"
            low = name.lower()
            clash = low in seen or low in taken or low in present
        seen.add(name.lower())
        names.append(name)
    return df if names == df.columns else df.toDF(*names)


def col(name: str):
    """A column reference that is safe for names with dots and back-quotes."""
    return F.col("`" + name.replace("`", "``") + "`")


def stable(df: DataFrame) -> DataFrame:
    """A frame whose partitions hold the same rows in the same order whenever they are computed.

    A chain of narrow steps over a file scan already does. After an exchange the order of rows
    may differ between attempts, so such a frame is checkpointed to the shared folder first.
    """
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "AdaptiveSparkPlan" in plan or "Exchange" in plan:
        shared_folder(df.sparkSession)
        return df.checkpoint()
    return df


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit hashes, mixed once more."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pack40(hashes: np.ndarray) -> bytes:
    """The low 40 bits of each."""
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpack40(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 5)
    return out.view("<u8").reshape(-1).astype(np.uint64)


#: Text that is exchanged by the hashes of its parts goes to one bucket for each so many bytes, or to as many as there are shuffle partitions.
BUCKET_BYTES = 32 << 20
MAX_BUCKETS = 1 << 16


def buckets_for(docs: DataFrame, text_col: str) -> int:
    """How many buckets the text of ``docs`` calls for: their size, which a task holds in memory, does not grow with the data."""
    size = docs.agg(F.sum(F.octet_length(col(text_col)))).first()[0] or 0
    return min(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES)), MAX_BUCKETS)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
