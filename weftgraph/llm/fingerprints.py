"""Document fingerprints by prefix polynomial hashes.

A text's prefix array holds, for every place, the polynomial hash of all code points before it,
modulo two primes near 2^31. Two array reads and a multiplication by an inverse power give the
62-bit hash of any span whatever its place, so that spans of different texts are compared in
constant time, and the longest common extension of two places is found by binary search. The
chance that one comparison of unequal spans errs is about their length over 2^62.

Passages that repeat across documents need no partner: a second prefix array, over the hashes of a text's words, gives the hash of every
window of WINDOW words. The windows are exchanged by hash in packed blobs, each block of documents sending a window that several of
its documents hold just once; where all copies of a window meet, it is told which ones other documents hold, and one bit for each goes
back. A run of such windows is a repeated passage. No pair of documents is formed, however many share a passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, col, lean, mix, pack40, stable, stash, tidy, unpack40

PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
#: Shared spans shorter than this many characters are not reported, unless they are a whole reference text.
MIN_CHARS = 100
#: Code points of reference text that one pass holds in memory; more take further passes.
REFERENCE_CHARS = 4_000_000
#: Words of a window; a repeated passage has more words than this.
WINDOW = 50
#: A block of documents ends at so many windows or documents.
BLOCK_WINDOWS, BLOCK_DOCS = 1_500_000, 1 << 16
#: Groups of equal texts are broadcast up to so many.
BROADCAST_GROUPS = 500_000


class _Powers:
    """Powers of the bases and of their inverses, grown by doubling and kept for the process."""

    def __init__(self) -> None:
        self.up = [np.ones(1, dtype=np.int64) for _ in PRIMES]
        self.down = [np.ones(1, dtype=np.int64) for _ in PRIMES]

    def grow(self, n: int) -> None:
        for k, (p, b) in enumerate(zip(PRIMES, BASES)):
            for tables, base in ((self.up, b), (self.down, pow(b, -1, p))):
                while len(tables[k]) < n:
                    t = tables[k]
                    tables[k] = np.concatenate((t, t * pow(base, len(t), p) % p))


_powers: list[_Powers] = []


def _tables(n: int) -> _Powers:
    if not _powers:
        _powers.append(_Powers())
    _powers[0].grow(n)
    return _powers[0]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class Prefix:
    """Prefix arrays of one text; ``span`` and ``spans`` hash any part of it."""

    def __init__(self, codes: np.ndarray) -> None:
        self.n = len(codes)
        self.powers = _tables(self.n + 1)
        c = codes.astype(np.int64) + 1
        self.sums = []
        for k, p in enumerate(PRIMES):
            h = np.zeros(self.n + 1, dtype=np.int64)
            np.cumsum(c * self.powers.up[k][: self.n] % p, out=h[1:])
            h %= p
            self.sums.append(h)

    def spans(self, start: np.ndarray, end: np.ndarray, k: int) -> np.ndarray:
        """Hashes modulo prime ``k`` of spans [start, end)."""
        h, p = self.sums[k], PRIMES[k]
        return (h[end] - h[start]) % p * self.powers.down[k][start] % p

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.spans(start, end, 0) << 31 | self.spans(start, end, 1)

    def span(self, start: int, end: int) -> int:
        a, b = ((int(h[end]) - int(h[start])) * int(self.powers.down[k][start]) % p for k, (h, p) in enumerate(zip(self.sums, PRIMES)))
        return a << 31 | b


def span_equal(a: Prefix, i: int, b: Prefix, j: int, n: int) -> bool:
    return i + n <= a.n and j + n <= b.n and a.span(i, i + n) == b.span(j, j + n)


def extend_right(a: Prefix, i: int, b: Prefix, j: int) -> int:
    """Length of the longest common extension to the right of places ``i`` and ``j``."""
    lo, hi = 0, min(a.n - i, b.n - j)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a.span(i, i + mid) == b.span(j, j + mid) else (lo, mid - 1)
    return lo


def extend_left(a: Prefix, i: int, b: Prefix, j: int) -> int:
    """Length of the longest common extension that ends just before ``i`` and ``j``."""
    lo, hi = 0, min(i, j)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a.span(i - mid, i) == b.span(j - mid, j) else (lo, mid - 1)
    return lo


_SPACE = np.array([chr(c).isspace() for c in range(0x3001)] + [False])


def words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words, which are runs of characters other than white space."""
    gap = np.concatenate(([True], _SPACE[np.minimum(codes, 0x3001)], [True]))
    return np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])


def window_hashes(p: Prefix, starts: np.ndarray, ends: np.ndarray, window: int) -> np.ndarray:
    """Hashes of all windows of so many words, whatever white space is between them."""
    n = len(starts)
    if n < window:
        return np.empty(0, np.uint64)
    out, powers = np.zeros(n - window + 1, dtype=np.uint64), _tables(n + 1)
    for k, q in enumerate(PRIMES):
        h = np.zeros(n + 1, dtype=np.int64)
        # a word's own hash and length, as one letter of the text of words
        letters = (p.spans(starts, ends, k) + 1 + (ends - starts) * 1000003) % q
        np.cumsum(letters * powers.up[k][:n] % q, out=h[1:])
        out = out << np.uint64(31) | ((h[window:] - h[:-window]) % q * powers.down[k][: n - window + 1] % q).astype(np.uint64)
    return mix(out + np.uint64(0x9E3779B97F4A7C15))


class References:
    """Reference texts, indexed by their blocks of half the smallest span.

    Any common span of ``min_chars`` holds a whole block, so that looking up every window of a
    document finds at least one place of each. A text below ``min_chars`` must be held whole; if it
    is even below a block, its first characters are indexed, as many as the largest power of two in its length.
    """

    def __init__(self, items: list[tuple[int, str]], min_chars: int) -> None:
        self.min_chars, whole = min_chars, (min_chars + 1) // 2
        self.items = [(i, Prefix(code_points(t))) for i, t in sorted(items)]
        #: By size of block: the places of each block's hash, and a gate for hashes modulo the first prime.
        self.blocks: dict[int, tuple[dict[int, list[tuple[int, int]]], np.ndarray]] = {}
        for n, (_, p) in enumerate(self.items):
            if not p.n:
                continue
            block = whole if p.n >= whole else 1 << (p.n.bit_length() - 1)
            starts = np.arange(0, p.n - block + 1, block) if block == whole else np.zeros(1, dtype=np.int64)
            at, gate = self.blocks.setdefault(block, ({}, np.zeros(1 << 22, dtype=bool)))
            for s, h in zip(starts.tolist(), p.hashes(starts, starts + block).tolist()):
                at.setdefault(h, []).append((n, s))
                gate[(h >> 31) & (len(gate) - 1)] = True

    def shared(self, doc: Prefix) -> list[tuple[int, int, int, int]]:
        """Maximal common spans as (item, start in text, start in item, length), sorted."""
        out: list[tuple[int, int, int, int]] = []
        reach: dict[tuple[int, int], int] = {}  # the end of the last span on (item, diagonal)
        for block, (at, gate) in self.blocks.items():
            if doc.n < block:
                continue
            starts = np.arange(doc.n - block + 1)
            first = doc.spans(starts, starts + block, 0)
            near = np.flatnonzero(gate[first & (len(gate) - 1)])
            for i, h in zip(near.tolist(), doc.hashes(near, near + block).tolist()):
                for n, j in at.get(h, ()):
                    if reach.get((n, i - j), -1) > i:
                        continue
                    item, p = self.items[n]
                    left = extend_left(doc, i, p, j)
                    length = left + extend_right(doc, i, p, j)
                    reach[n, i - j] = i - left + length
                    if length >= min(self.min_chars, p.n):
                        out.append((item, i - left, j - left, length))
        return sorted(out)


def fingerprint(
    df: DataFrame,
    reference: DataFrame | None = None,
    text_col: str = "text",
    id_col: str = "doc_id",
    ref_id: str = "item_id",
    ref_text: str = "text",
    min_chars: int = MIN_CHARS,
    reference_chars: int = REFERENCE_CHARS,
    window: int = WINDOW,
) -> DataFrame:
    """One row a document: ``doc_id``, ``n_points``, ``fingerprint``, ``same_as``, ``n_same``, ``spans``, ``repeats``.

    ``fingerprint`` is the hash of the whole text; ``same_as`` is the smallest id of an equal text of
    equal length and ``n_same`` counts such rows, the row itself included. ``spans`` lists all maximal
    spans of at least ``min_chars`` code points that the text shares with a reference text, as
    (item_id, start, item_start, length), sorted; a shorter reference text is found where it is held whole, an
    empty one nowhere. ``repeats`` lists, as (first_word, n_words), the longest runs of more than ``window`` words in which every window of so many
    words is found in another row as well, words being counted from 0 and told apart by their letters alone; whether the
    windows of a run are all from one other row is not asked. A null text has null ``fingerprint``,
    ``same_as`` and ``n_same``, no spans and no repeats; an empty one has fingerprint 0. Repeated rows are kept, each with
    its own row; they repeat one another's passages. Ids are integers, or strings of integers; any other string is an error. Reference rows without id or text are left out; an empty reference gives no
    spans. Reference text beyond ``reference_chars`` is taken in several passes over the documents, with the same result.
    """
    if min_chars < 2 or window < 1:
        raise ValueError("min_chars must be at least 2, window at least 1")
    docs = stable(tidy(df).select(col(id_col).cast("bigint").alias("doc_id"), col(text_col).alias("text")))
    passes: list[list[tuple[int, str]]] = [[]]
    if reference is not None:
        held = 0
        rows = tidy(reference).select(col(ref_id).cast("bigint").alias("i"), col(ref_text).alias("t")).filter("i IS NOT NULL AND t IS NOT NULL")
        for r in rows.toLocalIterator():
            if held and held + len(r["t"]) > reference_chars:
                passes.append([])
                held = 0
            passes[-1].append((r["i"], r["t"]))
            held += len(r["t"])
    buckets = buckets_for(docs, "text")
    sent = docs.mapInArrow(lean(_send(window, buckets)), _SENT).repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket")
    # the texts are hashed twice: their blocks would cross both exchanges otherwise
    told = docs.mapInArrow(lean(_tell(passes[0], min_chars, window, buckets)), _SENT)
    # and come first in the union, so that a partition has the same number, which its blocks are named by, in both passes
    back = told.unionByName(sent.mapInArrow(lean(_answer), _SENT)).repartition(buckets, "block").sortWithinPartitions("block")
    out = back.mapInArrow(lean(_receive(window, buckets)), _OUT)
    more = None
    for items in passes[1:]:
        rows = _hashed(docs, items, min_chars).filter("size(spans) > 0").select("doc_id", "n_points", "fingerprint", "spans").distinct()
        more = rows if more is None else more.unionByName(rows)
    if more is not None:
        key = ["doc_id", "n_points", "fingerprint"]  # equal for equal texts only, so that repeated rows and null ids share their spans
        more = more.groupBy(*key).agg(F.flatten(F.collect_list("spans")).alias("more")).select(*[F.col(k).alias(f"__{k}") for k in key], "more")
        same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key]
        out = out.join(more, same, "left").withColumn("spans", F.array_sort(F.concat("spans", F.coalesce("more", F.array()))))
    out = stash(out, "fingerprints")
    known = out.filter("fingerprint IS NOT NULL").groupBy("fingerprint", "n_points").agg(F.min("doc_id").alias("same_as"), F.count(F.lit(1)).alias("n_same"))
    several = stash(known.filter("n_same > 1"), "equal-texts").withColumnsRenamed({"fingerprint": "__f", "n_points": "__n"})
    if several.count() <= BROADCAST_GROUPS:
        several = F.broadcast(several)
    out = out.join(several, (F.col("fingerprint") == F.col("__f")) & (F.col("n_points") == F.col("__n")), "left")
    alone = F.when(F.col("fingerprint").isNotNull(), F.lit(1).cast("bigint"))
    first = F.when(F.col("n_same").isNull() & F.col("fingerprint").isNotNull(), F.col("doc_id")).otherwise(F.col("same_as"))
    return out.select("doc_id", "n_points", "fingerprint", first.alias("same_as"), F.coalesce("n_same", alone).alias("n_same"), "spans", "repeats")


_SENT = "bucket int, block bigint, kind int, a binary"
_SENT_ARROW = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("a", pa.binary())])
_SPANS = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("item_start", pa.int32()), ("length", pa.int32())]))
_DOCS = pa.schema([("doc_id", pa.int64()), ("n_points", pa.int64()), ("fingerprint", pa.int64()), ("spans", _SPANS), ("n", pa.int64())])
_OUT = "doc_id bigint, n_points bigint, fingerprint bigint, spans array<struct<item_id:bigint,start:int,item_start:int,length:int>>, repeats array<struct<first_word:int,n_words:int>>"
#: What a block sends: its documents and the buckets of their windows; windows that one of its documents holds; such as several hold.
_BLOCK, _ASKED, _KNOWN = 0, 1, 2


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SENT_ARROW)], schema=_SENT_ARROW)


def pack_codes(codes: np.ndarray, width: int) -> bytes:
    """Numbers of ``width`` bits each."""
    return np.packbits((codes[:, None] >> np.arange(width) & 1).astype(np.uint8)).tobytes()


def unpack_codes(data: bytes, n: int, width: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width).reshape(n, width)
    out = np.zeros(n, dtype=np.int32)
    for k in range(width):
        out |= bits[:, k].astype(np.int32) << k
    return out


class _Block:
    """Documents that are next to one another: the hashes of their windows, each window's bucket, and which ones several of them hold."""

    def __init__(self, number: int, docs: list[tuple], hashes: list[np.ndarray], buckets: int) -> None:
        self.number, self.docs = number, docs
        self.counts = np.array([len(h) for h in hashes], dtype=np.int64)
        self.hashes = h = np.concatenate(hashes)
        doc = np.repeat(np.arange(len(docs)), self.counts)
        self.bucket = ((h >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
        order = np.lexsort((doc, h))
        edge = np.flatnonzero(np.concatenate((np.ones(min(1, len(h)), dtype=bool), h[order][1:] != h[order][:-1])))
        low, high = (np.minimum.reduceat(doc[order], edge), np.maximum.reduceat(doc[order], edge)) if len(edge) else (edge, edge)
        self.shared = np.empty(len(h), dtype=bool)
        self.shared[order] = np.repeat(low < high, np.diff(np.append(edge, len(h))))
        self.known = order[edge[low < high]]  # one place of each window that several documents hold


def _blocks(batches: Iterator[pa.RecordBatch], window: int, buckets: int, refs: References | None) -> Iterator[_Block]:
    """The same at each attempt and in both passes; only with ``refs`` are the documents told."""
    part, made, held = TaskContext.get().partitionId(), 0, 0
    docs: list[tuple] = []
    hashes: list[np.ndarray] = []
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1)):
            t = t.as_py()
            if t is None:
                docs.append((i, None, None, []))
                hashes.append(np.empty(0, np.uint64))
            else:
                p = Prefix(codes := code_points(t))
                spans = [dict(zip(("item_id", "start", "item_start", "length"), s)) for s in refs.shared(p)] if refs else []
                docs.append((i, p.n, p.span(0, p.n), spans))
                hashes.append(window_hashes(p, *words(codes), window))
            held += len(hashes[-1])
            if held >= BLOCK_WINDOWS or len(docs) >= BLOCK_DOCS:
                yield _Block(part << 24 | made, docs, hashes, buckets)
                docs, hashes, held, made = [], [], 0, made + 1
    if docs:
        yield _Block(part << 24 | made, docs, hashes, buckets)


def _send(window: int, buckets: int):
    """Texts to the windows that their blocks send to each bucket, those to be asked for in order of place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _blocks(batches, window, buckets, None):
            rows = []
            for kind, places in ((_ASKED, np.flatnonzero(~x.shared)), (_KNOWN, x.known)):
                by = np.argsort(x.bucket[places], kind="stable")
                cuts = np.searchsorted(x.bucket[places][by], np.arange(buckets + 1))
                rows += [(k, x.number, kind, pack40(x.hashes[places[by[cuts[k] : cuts[k + 1]]]])) for k in np.flatnonzero(np.diff(cuts)).tolist()]
            if rows:
                yield _rows(rows)

    return run


def _tell(items: list[tuple[int, str]], min_chars: int, window: int, buckets: int):
    """Texts to their blocks' documents, with the bucket of each window that was asked for, or 0."""
    width = buckets.bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _blocks(batches, window, buckets, References(items, min_chars)):
            table = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*(d + (int(n),) for d, n in zip(x.docs, x.counts))), _DOCS)], schema=_DOCS)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, _DOCS) as writer:
                writer.write_batch(table)
            held = sink.getvalue().to_pybytes()
            codes = pack_codes(np.where(x.shared, 0, x.bucket + 1), width)
            yield _rows([(0, x.number, _BLOCK, len(held).to_bytes(8, "little") + held + codes)])

    return run


def _groups(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[list[tuple]]:
    """Rows that follow one another and are equal in column ``by``."""
    now, rows = None, []
    for b in batches:
        for r in zip(*(b.column(k).to_pylist() for k in range(4))):
            if r[by] != now and rows:
                yield rows
                rows = []
            now = r[by]
            rows.append(r)
    if rows:
        yield rows


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket by bucket: for each window that is asked for, one bit, whether another block or several documents of one hold it."""
    for rows in _groups(batches, 0):
        out = []
        asked = [unpack40(r[3]) for r in rows if r[2] == _ASKED]
        known = [unpack40(r[3]) for r in rows if r[2] == _KNOWN]
        # a block asks for one document's windows; where these repeat within it, that is no other document
        every = np.sort(np.concatenate([np.empty(0, np.uint64), *map(np.unique, asked), *known, *known]))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        for r, h in zip((r for r in rows if r[2] == _ASKED), asked):
            at = np.searchsorted(twice, h)
            bits = twice[np.minimum(at, len(twice) - 1)] == h if len(twice) else np.zeros(len(h), dtype=bool)
            out.append((r[0], r[1], _ASKED, np.packbits(bits).tobytes()))
        if out:
            yield _rows(out)


def _receive(window: int, buckets: int):
    """Block by block: the documents with their repeated passages."""
    width = buckets.bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 1):
            data = next(r[3] for r in rows if r[2] == _BLOCK)
            size = int.from_bytes(data[:8], "little")
            docs = pa.ipc.open_stream(pa.py_buffer(data[8 : 8 + size])).read_next_batch()
            counts = docs.column(4).to_numpy()
            total = int(counts.sum())
            codes = unpack_codes(data[8 + size :], total, width)
            order = np.argsort(codes, kind="stable")
            each = np.bincount(codes, minlength=1) if total else np.zeros(1, np.int64)
            flags = np.ones(total, dtype=bool)
            answers = sorted((r[0], r[3]) for r in rows if r[2] == _ASKED)
            bits = [np.unpackbits(np.frombuffer(a, np.uint8), count=int(each[k + 1])).astype(bool) for k, a in answers]
            flags[order[each[0] :]] = np.concatenate([np.empty(0, bool), *bits])
            ends = np.cumsum(counts)
            # runs of at least two windows, none of them over the end of a document
            on = np.zeros(total + len(counts) + 1, dtype=np.int8)
            doc = np.repeat(np.arange(len(counts)), counts)
            on[np.arange(total) + doc + 1] = flags
            step = np.diff(np.append(on, 0))
            first, last = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
            long = last - first >= 2
            first, last = first[long], last[long]
            of = np.searchsorted(ends + np.arange(len(counts)), first, side="right") if len(counts) else first
            start = first - of - (ends - counts)[of] if len(first) else first
            made = pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array((last - first + window - 1).astype(np.int32))], ["first_word", "n_words"])
            offsets = np.searchsorted(of, np.arange(len(counts) + 1)).astype(np.int32)
            repeats = pa.ListArray.from_arrays(pa.array(offsets), made)
            yield pa.RecordBatch.from_arrays([*docs.columns[:4], repeats], ["doc_id", "n_points", "fingerprint", "spans", "repeats"])

    return run


def _hashed(docs: DataFrame, items: list[tuple[int, str]], min_chars: int) -> DataFrame:
    """``doc_id``, ``n_points``, ``fingerprint`` and ``spans`` of each row, without windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = References(items, min_chars)
        for b in batches:
            rows = []
            for t in b.column(1):
                t = t.as_py()
                p = None if t is None else Prefix(code_points(t))
                rows.append((None, None, []) if p is None else (p.n, p.span(0, p.n), [dict(zip(("item_id", "start", "item_start", "length"), s)) for s in refs.shared(p)]))
            made = [pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else ((), (), ()), list(_DOCS)[1:4])]
            yield pa.RecordBatch.from_arrays([b.column(0), *made], _DOCS.names[:4])

    return docs.mapInArrow(lean(run), _OUT.rsplit(", ", 1)[0])
