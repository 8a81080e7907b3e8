"""Token ids as bits: canonical length-limited Huffman codes from global counts.

One pass counts all ids; package-merge turns the counts into code lengths of at most ``max_len`` bits,
and lengths alone fix the canonical codes. Every row's ids become one bit string, with the bit offset of
every ``block``-th id beside it: any block can be decoded without the others, by one table
lookup for each id. Ids come as arrays, or as binary columns of little-endian 32-bit numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, lean, tidy

MAX_LEN, BLOCK = 20, 1024
#: Distinct ids a code book may have.
MAX_IDS = 1 << 20
#: Ids below this are looked up and counted by tables.
DENSE = 1 << 22
#: Ids that are coded in one go, which bounds memory.
SLICE_IDS = 1 << 19


def code_lengths(counts: np.ndarray, max_len: int = MAX_LEN) -> np.ndarray:
    """Optimal code lengths of at most ``max_len``, by package-merge; ``counts`` are positive."""
    n = len(counts)
    if n == 0:
        return np.empty(0, dtype=np.int64)
    if n > 1 << max_len:
        raise ValueError(f"{n} ids do not fit codes of {max_len} bits")
    if n == 1:
        return np.ones(1, dtype=np.int64)
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.int64)
    levels, now = [], leaves
    is_leaf = np.ones(n, dtype=bool)
    for _ in range(max_len - 1):
        levels.append(is_leaf)
        pairs = now[: len(now) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate((leaves, pairs))
        rank = np.argsort(both, kind="stable")
        now, is_leaf = both[rank], rank < n
    levels.append(is_leaf)
    lengths, take = np.zeros(n, dtype=np.int64), 2 * n - 2
    for is_leaf in reversed(levels):
        used = int(is_leaf[:take].sum())
        lengths[:used] += 1
        take = 2 * (take - used)
    out = np.empty(n, dtype=np.int64)
    out[order] = lengths
    return out


class Book:
    """Canonical codes: ids by (length, id) get consecutive codes."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        order = np.lexsort((ids, lengths))
        self.ids, self.lengths = ids[order].astype(np.int64), lengths[order].astype(np.int64)
        self.max_len = int(self.lengths[-1]) if len(order) else 1
        width = np.int64(1) << (self.max_len - self.lengths)
        first = np.concatenate(([0], np.cumsum(width)))
        self.codes = first[:-1] >> (self.max_len - self.lengths)
        by_id = np.argsort(self.ids)
        self._sorted, self._by_id = self.ids[by_id], by_id
        self._first = first
        self._dense = self._table = None
        if len(order) and self._sorted[0] >= 0 and self._sorted[-1] < DENSE:
            self._dense = np.full(int(self._sorted[-1]) + 1, -1, dtype=np.int32)
            self._dense[self._sorted] = by_id

    def table(self) -> np.ndarray:
        """For every string of ``max_len`` bits the place of its id in ``ids``, and in the low 5 bits the length of its code."""
        if self._table is None:
            reps = np.diff(self._first)
            free = (1 << self.max_len) - int(self._first[-1])  # only with a single id
            places = np.concatenate((np.repeat(np.arange(len(self.ids)) << 5 | self.lengths, reps), np.full(free, 1)))
            self._table = places.astype(np.int32)
        return self._table

    def look_up(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and lengths of ``ids``; by a table where ids are small, else by binary search."""
        if not len(ids):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        if self._dense is not None:
            if ids.min() < 0 or ids.max() >= len(self._dense):
                raise ValueError("an id is not in the code book")
            at = self._dense[ids]
            known = at.min() >= 0
        else:
            at = np.searchsorted(self._sorted, ids)
            known = len(self._sorted) > 0 and (self._sorted[np.minimum(at, len(self._sorted) - 1)] == ids).all()
            at = self._by_id[at] if known else at
        if not known:
            raise ValueError("an id is not in the code book")
        return self.codes[at], self.lengths[at]


def pack_bits(codes: np.ndarray, lengths: np.ndarray, starts: np.ndarray, n_words: int) -> np.ndarray:
    """Big-endian 64-bit words with ``codes`` at bit places ``starts``, which ascend and do not overlap."""
    words = np.zeros(n_words + 1, dtype=np.uint64)
    if len(codes):
        at, room = starts >> 6, 64 - (starts & 63) - lengths
        c = codes.astype(np.uint64)
        high = np.where(room >= 0, c << np.maximum(room, 0).astype(np.uint64), c >> np.maximum(-room, 0).astype(np.uint64))
        edge = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        words[at[edge]] = np.bitwise_or.reduceat(high, edge)
        over = np.flatnonzero(room < 0)
        words[at[over] + 1] |= c[over] << (64 + room[over]).astype(np.uint64)
    return words[:n_words]


def encode_rows(flat: np.ndarray, counts: np.ndarray, book: Book, block: int = BLOCK) -> list[tuple[int, int, bytes, list[int]]]:
    """(ids, bits, bit string, checkpoints) of rows that have ``counts`` of the ids in ``flat``, all packed in one go."""
    codes, lens = book.look_up(flat)
    ends = np.cumsum(counts)
    total = np.concatenate(([0], np.cumsum(lens)))
    first, bits = total[ends - counts], total[ends] - total[ends - counts]
    words = (bits + 63) // 64
    base = np.concatenate(([0], np.cumsum(words)))
    starts = total[:-1] - np.repeat(first - base[:-1] * 64, counts)
    data = pack_bits(codes, lens, starts, int(base[-1])).astype(">u8").tobytes()
    out = []
    for n, end, size, at, before in zip(counts.tolist(), ends.tolist(), bits.tolist(), (base[:-1] * 8).tolist(), first.tolist()):
        out.append((n, size, data[at : at + (size + 7) // 8], (total[end - n : end : block] - before).tolist()))
    return out


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids and how many each row has; null lists have none, null ids are left out."""
    if pa.types.is_binary(lists.type):
        counts = pc.fill_null(pc.binary_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64) // 4
        return np.frombuffer(b"".join(x for x in lists.to_pylist() if x), dtype="<u4"), counts
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    if flat.null_count:
        gone = np.concatenate(([0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))))
        ends = np.cumsum(counts)
        counts = counts - (gone[ends] - gone[ends - counts])
        flat = flat.drop_null()
    return flat.to_numpy(zero_copy_only=False), counts


def _slices(counts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows with about SLICE_IDS ids together."""
    ends, lo = np.cumsum(counts), 0
    while lo < len(counts):
        before = int(ends[lo] - counts[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, before + SLICE_IDS, side="right")))
        yield lo, hi
        lo = hi


def _ids_column(df: DataFrame, ids_col: str) -> F.Column:
    kind = df.select(col(ids_col)).schema[0].dataType
    plain = isinstance(kind, T.BinaryType) or isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.IntegerType, T.LongType))
    return col(ids_col) if plain else col(ids_col).cast("array<bigint>")


def decode_block(bits: bytes, start: int, n: int, book: Book) -> list[int]:
    """``n`` ids from bit ``start`` on, one table lookup each."""
    table = book.table()
    out, m = [], book.max_len
    at = start
    for _ in range(n):
        byte = at >> 3
        window = int.from_bytes(bits[byte : byte + 4].ljust(4, b"\0"), "big")
        k = (window >> (32 - m - (at & 7))) & ((1 << m) - 1)
        out.append(int(book.ids[table[k] >> 5]))
        at += int(table[k]) & 31
    return out


def decode_blocks(data: bytes, starts: np.ndarray, counts: np.ndarray, book: Book) -> np.ndarray:
    """The ids of blocks of ``counts`` ids that start at bits ``starts`` of ``data``; all blocks go side by side, one lookup an id."""
    total = int(counts.sum())
    if not total:
        return np.empty(0, dtype=np.int64)
    table, m = book.table(), book.max_len
    raw = np.frombuffer(data + b"\0" * 8, dtype=np.uint8).astype(np.uint32)
    windows = (raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]).astype(np.int64)
    order = np.argsort(-counts, kind="stable")  # the longest first: those that go on are always at the front
    at, to = starts[order].astype(np.int64), (np.cumsum(counts) - counts)[order]
    going = len(counts) - np.cumsum(np.bincount(counts, minlength=int(counts.max()) + 1))
    found, mask, room = np.empty(total, dtype=np.int32), (1 << m) - 1, 32 - m
    for step, n in enumerate(going[:-1].tolist()):
        here = at[:n]
        k = table[windows[here >> 3] >> (room - (here & 7)) & mask]
        found[to[:n] + step] = k
        here += k & 31
    return book.ids[found >> 5]


def decode_rows(bits: list[bytes | None], n_ids: list[int | None], marks: list, book: Book, block: int = BLOCK) -> list[np.ndarray | None]:
    """The ids of each row, None for a null one, in slices of about SLICE_IDS ids."""
    out: list[np.ndarray | None] = []
    for lo, hi in _slices(np.array([n or 0 for n in n_ids], dtype=np.int64)):
        rows = [k for k in range(lo, hi) if bits[k] is not None]
        base = np.cumsum([0, *(len(bits[k]) for k in rows)]) * 8
        starts = [np.asarray(marks[k], dtype=np.int64) + base[j] for j, k in enumerate(rows)]
        counts = [np.minimum(n_ids[k] - np.arange(len(marks[k]), dtype=np.int64) * block, block) for k in rows]
        none = np.empty(0, dtype=np.int64)
        flat = decode_blocks(b"".join(bits[k] for k in rows), np.concatenate([none, *starts]), np.concatenate([none, *counts]), book)
        parts = iter(np.split(flat, np.cumsum([n_ids[k] for k in rows])[:-1])) if rows else iter(())
        out += [None if bits[k] is None else next(parts) for k in range(lo, hi)]
    return out


def build_book(df: DataFrame, ids_col: str = "token_ids", max_len: int = MAX_LEN) -> Book:
    """The code book of all ids of all rows; null lists and null ids do not count.

    More than MAX_IDS distinct ids are an error: a book is held by the driver and every worker.
    """
    if max_len > 24:
        raise ValueError("codes have at most 24 bits")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense, rest = np.zeros(0, dtype=np.int64), {}
        for b in batches:
            flat, _ = _flat(b.column(0))
            for at in range(0, len(flat), SLICE_IDS):
                ids = flat[at : at + SLICE_IDS]
                if ids.min() >= 0 and ids.max() < DENSE:
                    n = np.bincount(ids)
                    dense = np.pad(dense, (0, max(0, len(n) - len(dense))))
                    dense[: len(n)] += n
                else:
                    for i, c in zip(*(x.tolist() for x in np.unique(ids, return_counts=True))):
                        rest[i] = rest.get(i, 0) + c
        some = np.flatnonzero(dense)
        yield pa.RecordBatch.from_arrays([pa.array([*some.tolist(), *rest], pa.int64()), pa.array([*dense[some].tolist(), *rest.values()], pa.int64())], ["id", "n"])

    df = tidy(df)
    lists = df.select(_ids_column(df, ids_col).alias("ids"))
    counts = lists.mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    rows = counts.limit(MAX_IDS + 1).collect()
    if len(rows) > MAX_IDS:
        raise ValueError(f"more than {MAX_IDS} distinct ids")
    rows.sort()
    return Book(np.array([r["id"] for r in rows], np.int64), code_lengths(np.array([r["n"] for r in rows], np.int64), max_len))


Into = tuple[str, T.DataType, Callable[[Iterator[pa.Array]], Iterator[pa.Array]]]
_OUT = ("n_tokens", "n_bits", "bits", "checkpoints")


def compress(df: DataFrame, book: Book, ids_col: str = "token_ids", block: int = BLOCK) -> DataFrame:
    """All columns but ``ids_col``, with ``n_tokens``, ``n_bits``, ``bits`` and ``checkpoints``.

    A null list has null outputs, an empty one no bits and no checkpoints; null ids in a list are
    left out, as in the counts. Repeated rows are coded alike. Input columns that have the name of an output get
    ``_in`` behind theirs. An id that is not in the book is an error.
    """
    df = tidy(df, _OUT, keep=(ids_col,))
    rest = [c for c in df.columns if c.lower() != ids_col.lower()]
    lists = df.select(*[col(c) for c in rest], _ids_column(df, ids_col).alias("__ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(b.num_columns - 1)
            flat, counts = _flat(ids)
            ends = np.cumsum(counts)
            made = [r for lo, hi in _slices(counts) for r in encode_rows(flat[ends[lo] - counts[lo] : ends[hi - 1]], counts[lo:hi], book, block)]
            made = [r if ok else (None,) * 4 for r, ok in zip(made, ids.is_valid().to_pylist())]
            n, bits, data, marks = zip(*made) if made else ((),) * 4
            cols = [pa.array(n, pa.int32()), pa.array(bits, pa.int64()), pa.array(data, pa.binary()), pa.array(marks, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], [*rest, *_OUT])

    kinds = (T.IntegerType(), T.LongType(), T.BinaryType(), T.ArrayType(T.LongType()))
    schema = T.StructType(lists.schema.fields[:-1] + [T.StructField(n, k) for n, k in zip(_OUT, kinds)])
    return lists.mapInArrow(lean(run), schema)


def decompress(df: DataFrame, book: Book, block: int = BLOCK, keep: bool = False, into: Into | None = None) -> DataFrame:
    """All other columns of ``compress``, with ``keep`` its own as well, with ``token_ids`` (array<bigint>) back again.

    ``into`` is a column's name and type and a step from lists of ids to it, which then takes the place of ``token_ids``.
    Null ``bits`` give null, a row of no ids gives an empty list. Repeated rows are decoded alike. A book other than the one that coded the rows gives
    other ids. An input column of the new one's name is kept with ``_in`` behind it.
    """
    new, kind, step = into or ("token_ids", T.ArrayType(T.LongType()), lambda lists: lists)
    df = tidy(df, (new,))
    names = [c.lower() for c in df.columns]
    coded = [names.index(c) for c in ("n_tokens", "bits", "checkpoints")]
    rest = [k for k, c in enumerate(names) if keep or c not in _OUT]
    schema = T.StructType([df.schema.fields[k] for k in rest] + [T.StructField(new, kind)])
    columns = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(batch.column(coded[0]), 0).to_numpy().astype(np.int64)
            for lo, hi in _slices(sizes):
                b = batch.slice(lo, hi - lo)
                rows = decode_rows(*(b.column(k).to_pylist() for k in (coded[1], coded[0], coded[2])), book, block)
                offsets = np.cumsum([0, *(0 if r is None else len(r) for r in rows)], dtype=np.int32)
                flat = np.concatenate([np.empty(0, np.int64), *(r for r in rows if r is not None)])
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array([r is None for r in rows], pa.bool_()))
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in rest), *step(iter([ids]))], columns)

    return df.mapInArrow(lean(run), schema)


def book_row(spark: SparkSession, book: Book) -> DataFrame:
    """One row, ``book_ids`` and ``book_lengths``, from which ``read_book`` makes the book again; an empty book has empty lists."""
    return spark.createDataFrame([(book.ids.tolist(), book.lengths.tolist())], "book_ids array<bigint>, book_lengths array<int>")


def read_book(df: DataFrame) -> Book:
    """The book in the one row of ``df`` that has ``book_ids``."""
    ids, lengths = df.select("book_ids", "book_lengths").filter("book_ids IS NOT NULL").first()
    return Book(np.array(ids, dtype=np.int64), np.array(lengths, dtype=np.int64))
