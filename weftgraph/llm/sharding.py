"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Row ``p`` of the matrix says how many rows of input partition ``p`` go to each shard. Its row
sums are the partition sizes, its column sums the shard sizes, and its law is the multivariate
hypergeometric one that a uniform permutation of all rows would give. No process ever holds the
whole matrix: a binary tree over the partitions splits the shard sizes at every node with a
generator seeded by the node, so that a task redraws just its own row in ``log2(P)`` draws and
gets the same row after a lost executor. The driver sends the partition sizes only. A large shard is several columns
of the matrix, bins that follow one another in it, so that no task holds more than a bin.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, stable, tidy

#: A shard of more rows is exchanged and permuted in several bins of exact sizes, so that tasks stay small.
BIN_ROWS = 50_000
_NUMPY_LIMIT = 10**9
_LOCAL_BITS = 33


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """One exact draw; beyond numpy's limit of 10^9 by inverting the mass around the mode."""
    if n == 0 or good == 0:
        return 0
    if bad == 0:
        return n
    if good + bad < _NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, n))
    total = good + bad
    lo, hi = max(0, n - bad), min(n, good)
    mode = min(max((n + 1) * (good + 1) // (total + 2), lo), hi)
    sd = (n * (good / total) * (bad / total) * ((total - n) / max(1, total - 1))) ** 0.5
    reach = int(12 * sd) + 64
    a, b = max(lo, mode - reach), min(hi, mode + reach)
    k = np.arange(a, b, dtype=np.float64)
    step = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    mass = np.concatenate(([0.0], np.cumsum(step)))
    cdf = np.cumsum(np.exp(mass - mass.max()))
    return a + int(np.searchsorted(cdf, rng.random() * cdf[-1], side="right").clip(0, b - a))


def split(rng: np.random.Generator, totals: np.ndarray, n: int) -> np.ndarray:
    """Multivariate hypergeometric: how many of each shard's rows are among ``n`` of all rows.

    Beyond numpy's limit of 10^9 rows the shards are first taken in runs of fewer rows, one draw for each run, and then shard by shard within it.
    """
    rest = int(totals.sum())
    if rest < _NUMPY_LIMIT:
        return rng.multivariate_hypergeometric(totals, n, method="marginals")
    out = np.zeros_like(totals)
    ends = np.cumsum(totals)
    lo = 0
    while lo < len(totals):
        before = int(ends[lo] - totals[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, before + _NUMPY_LIMIT - 1, side="right")))
        size = int(ends[hi - 1]) - before
        rest -= size
        drawn = hypergeometric(rng, size, rest, n)
        out[lo:hi] = drawn if hi == lo + 1 else rng.multivariate_hypergeometric(totals[lo:hi], drawn, method="marginals")
        n -= drawn
        lo = hi
    return out


def shard_sizes(n_rows: int, n_shards: int) -> np.ndarray:
    """As equal as can be; the first ones get one row more."""
    return np.array([n_rows // n_shards + (s < n_rows % n_shards) for s in range(n_shards)], dtype=np.int64)


def bin_sizes(n_rows: int, n_shards: int, bins: int) -> np.ndarray:
    """The sizes of the shards' bins, ``bins`` for each, as equal as can be within a shard."""
    return np.concatenate([shard_sizes(n, bins) for n in shard_sizes(n_rows, n_shards).tolist()])


def matrix_row(partition_sizes: np.ndarray, n_shards: int, p: int, seed: int, bins: int = 1) -> np.ndarray:
    """Row ``p`` of the communication matrix, with ``bins`` columns for each shard."""
    ends = np.concatenate(([0], np.cumsum(partition_sizes)))
    totals = bin_sizes(int(ends[-1]), n_shards, bins)
    lo, hi = 0, len(partition_sizes)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = split(np.random.default_rng([seed, lo, hi]), totals, int(ends[mid] - ends[lo]))
        if p < mid:
            totals, hi = left, mid
        else:
            totals, lo = totals - left, mid
    return totals


def permuted_labels(partition_sizes: np.ndarray, n_shards: int, p: int, seed: int, bins: int = 1) -> np.ndarray:
    """The bin of each row of partition ``p``: its matrix row, locally permuted."""
    labels = np.repeat(np.arange(n_shards * bins, dtype=np.int32), matrix_row(partition_sizes, n_shards, p, seed, bins))
    np.random.default_rng([seed, len(partition_sizes), p, 1]).shuffle(labels)
    return labels


def shard(df: DataFrame, n_shards: int, seed: int = 0, bin_rows: int = BIN_ROWS) -> DataFrame:
    """Add ``shard`` (int) and ``shard_pos`` (bigint, 0-based place in the shard).

    Every row lands in exactly one shard; sizes differ by one at most; given the input's
    partitions, the result depends on ``seed`` only. Null values, long texts and repeated rows are
    carried along as they are: rows are told apart by place, not by value. A shard of more than ``bin_rows`` rows is made of several
    bins, which changes the order that a seed gives but neither its law nor the sizes. An empty table gives
    an empty result; with fewer rows than shards the last shards stay empty. Input columns
    called ``shard`` or ``shard_pos`` are kept as ``shard_in`` and ``shard_pos_in``.
    """
    if n_shards < 1 or bin_rows < 1:
        raise ValueError("n_shards and bin_rows must be at least 1")
    df = stable(tidy(df, ("shard", "shard_pos", "__row", "__key", "__bin")))
    found = df.groupBy(F.spark_partition_id().alias("p")).count().collect()  # one small row a partition
    sizes = np.zeros(max((r["p"] for r in found), default=-1) + 1, dtype=np.int64)
    for r in found:
        sizes[r["p"]] = r["count"]
    n_rows = int(sizes.sum())
    bins = max(1, -(-n_rows // (n_shards * bin_rows)))

    @F.pandas_udf("int")
    def place(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
        @functools.lru_cache(maxsize=1)
        def labels(p: int) -> np.ndarray:
            return permuted_labels(sizes, n_shards, p, seed, bins)

        for batch in rows:
            ids = batch.to_numpy()
            parts, out = ids >> _LOCAL_BITS, np.empty(len(ids), dtype=np.int32)
            for p in np.unique(parts):
                here = parts == p
                out[here] = labels(int(p))[ids[here] & ((1 << _LOCAL_BITS) - 1)]
            yield pd.Series(out)

    names = df.columns
    labelled = df.withColumn("__row", F.monotonically_increasing_id()).withColumn("__bin", place("__row"))
    labelled = labelled.withColumn("__key", F.xxhash64(F.lit(seed), F.col("__row")))
    inside = Window.partitionBy("__bin").orderBy("__key", "__row")
    shard_ = F.expr(f"CAST(__bin DIV {bins} AS INT)").alias("shard")
    # the rows of the shard's bins before this one
    size = F.lit(n_rows // n_shards) + (shard_ < n_rows % n_shards).cast("bigint")
    nth = F.pmod("__bin", F.lit(bins)).cast("bigint")
    before = nth * F.floor(size / bins).cast("bigint") + F.least(nth, F.pmod(size, F.lit(bins)))
    pos = before + F.row_number().over(inside).cast("bigint") - 1
    return labelled.select(*[col(c) for c in names], shard_, pos.alias("shard_pos"))
