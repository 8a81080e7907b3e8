"""Exact n-gram Jaccard self-join by prefixes of token combinations.

A document is the set of its word n-grams, hashed. The steps, each linear in the tokens it reads:

1. Tokens are exchanged by hash in packed blobs; where all copies of a token meet, its document
   frequency is counted, and only tokens that at least two documents hold go back. A document with
   more unshared tokens than its error budget ``|x| - ceil(t |x|)`` cannot match and is dropped.
2. Equal sets are collapsed to one.
3. Every remaining set, its tokens in order of frequency, indexes a prefix. Rare tokens (frequency up to
   ``rare_df``, less for large sets) are indexed alone, frequent ones in pairs within hashed subclasses. A pair of sets that lose at
   most ``e`` tokens lacks a common entry only if each subclass keeps at most one common token, so the
   prefix is extended until rare tokens plus, for each subclass, frequent tokens less one, exceed ``e``.
4. Sets that share an entry, each within the prefix that the pair's sizes call for, are candidates. They are verified by
   their shared tokens, a group of candidates in one place.
5. An entry of more than ``HEAVY_RUN`` sets is not paired, which would take the square of them for each entry. Its sets are linked
   to one of them; sets that such links connect are a group, and all pairs of a group are counted once, in tiles of two
   blocks, by products of matrices. A tile tells how many links each set has, the greatest index and a spanning forest, no pairs.

Long texts that have nothing to do with each other share many tokens by chance, the more the larger the table: as single entries these would make
all pairs of such texts candidates. Subclasses number with the sets' size, so that the pairs stay in proportion to the prefix; sets near the end of
a size class index in the next one too. The registered result has one row a document, with its class and how many documents it is
linked to: pairs of a group of copies are counted, not listed. The result is exact up to hash collisions, whose chance for a token
is about 3e-6, as bits stay in proportion to the number of partitions. No candidate is capped: a group of m sets takes m^2 / 2
comparisons, of some ten nanoseconds each where 400 tokens are common.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets_for, col, lean, mix, pack40, stable, stash, tidy, unpack40
from .fingerprints import BASES, PRIMES, _tables, code_points

N, THRESHOLD, RARE_DF = 3, 0.55, 32
#: Ids of dropped documents are broadcast up to this number, which is 16 MB; beyond, documents are shuffled.
BROADCAST_IDS = 2_000_000
_CHUNK_CHARS, _BLOCK_TOKENS = 1 << 18, 1_500_000
#: Most documents of a block, empty ones included; their places have 20 bits.
_BLOCK_DOCS = 1 << 16
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> str:
    """Lower-cased words with single spaces between."""
    return " ".join((text or "").lower().split())


def chunk_tokens(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document number, token) of all distinct n-grams of normalised texts, sorted.

    A text of fewer than ``n`` words has itself as its only token; an empty one has none.
    """
    joined = code_points("\n".join(texts) + "\n").astype(np.int64)
    gap = (joined == 32) | (joined == 10)
    ends = np.flatnonzero(gap)
    starts = np.concatenate(([0], ends[:-1] + 1))
    doc = np.cumsum(np.concatenate(([0], (joined[ends] == 10)[:-1])))
    full = ends > starts  # the rest is an empty text
    starts, ends, doc = starts[full], ends[full], doc[full]
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    counts = np.bincount(doc, minlength=len(texts))
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    short = np.flatnonzero((counts > 0) & (counts < n))
    same = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :]) if len(doc) >= n else np.empty(0, np.int64)
    a = np.concatenate((starts[same], starts[first[short]]))
    b = np.concatenate((ends[same + n - 1], ends[first[short] + counts[short] - 1]))
    d = np.concatenate((doc[same], short))
    powers, token = _tables(len(joined) + 1), np.zeros(len(a), dtype=np.uint64)
    for k, p in enumerate(PRIMES):
        h = np.zeros(len(joined) + 1, dtype=np.int64)
        np.cumsum((joined + 1) * powers.up[k][: len(joined)] % p, out=h[1:])
        token = token << np.uint64(31) | ((h[b] - h[a]) % p * powers.down[k][a] % p).astype(np.uint64)
    token = mix(token + _MIX)
    order = np.lexsort((token, d))
    d, token = d[order], token[order]
    new = np.concatenate(([True], (d[1:] != d[:-1]) | (token[1:] != token[:-1])))
    return d[new], token[new]


_SCHEMA = "bucket int, block bigint, kind int, a binary, b binary, c binary"
_ARROW = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def _spread(n: int, buckets: int):
    """Blocks of documents to rows for each bucket: tokens (a), how many of each document (b)."""

    def rows_of(block: int, ids: list[int], docs: np.ndarray, tokens: np.ndarray) -> list[tuple]:
        sizes = np.bincount(docs, minlength=len(ids))
        out = [(block % buckets, block, 0, np.array(ids, "<i8").tobytes(), sizes.astype("<u4").tobytes(), None)]
        bucket = ((tokens >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in range(buckets):
            here = order[cuts[b] : cuts[b + 1]]
            if len(here):
                out.append((b, block, 1, pack40(tokens[here]), np.bincount(docs[here], minlength=len(ids)).astype("<u4").tobytes(), None))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        docs: list[np.ndarray] = []
        toks: list[np.ndarray] = []
        texts: list[str] = []
        chars = held = 0

        def flush() -> None:
            nonlocal texts, chars, held
            d, t = chunk_tokens(texts, n)
            docs.append(d + len(ids) - len(texts))
            toks.append(t)
            held += len(t)
            texts, chars = [], 0

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                ids.append(i)
                texts.append(words_of(t.as_py()))
                chars += len(texts[-1])
                if chars >= _CHUNK_CHARS or len(ids) == _BLOCK_DOCS:
                    flush()
                    if held >= _BLOCK_TOKENS or len(ids) == _BLOCK_DOCS:
                        yield _batch(rows_of(part << 24 | made, ids, np.concatenate(docs), np.concatenate(toks)))
                        ids, docs, toks, held, made = [], [], [], 0, made + 1
        flush()
        if ids:
            yield _batch(rows_of(part << 24 | made, ids, np.concatenate(docs), np.concatenate(toks)))

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket by bucket: keep the tokens of frequency 2 and more, with it (c, up to 65535)."""
    bucket, rows = -1, []

    def done() -> pa.RecordBatch | None:
        out = [r for r in rows if r[2] == 0]
        told = [r for r in rows if r[2] == 1]
        if told:
            tokens = np.concatenate([unpack40(r[3]) for r in told])
            order = np.argsort(tokens)
            ordered = tokens[order]
            edge = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1], [True]))).astype(np.int32)
            del ordered
            runs = np.diff(edge)
            df = np.empty(len(tokens), dtype=np.int32)
            df[order] = np.repeat(runs, runs)
            del order
            at = 0
            for r in told:
                counts = np.frombuffer(r[4], "<u4")
                k = int(counts.sum())
                shared = df[at : at + k] > 1
                if shared.any():
                    doc = np.repeat(np.arange(len(counts)), counts)[shared]
                    left = np.bincount(doc, minlength=len(counts)).astype("<u4").tobytes()
                    out.append((r[0], r[1], 1, pack40(tokens[at : at + k][shared]), left, np.minimum(df[at : at + k][shared], 65535).astype("<u2").tobytes()))
                at += k
        return _batch(out) if out else None

    for b in batches:
        for r in zip(*(b.column(k).to_pylist() for k in range(6))):
            if r[0] != bucket:
                if rows and (made := done()):
                    yield made
                bucket, rows = r[0], []
            rows.append(r)
    if rows and (made := done()):
        yield made


_SETS = "rec bigint, doc_id bigint, size int, unshared int, whole bigint, tokens array<bigint>, dfs array<int>"


def _gather(threshold: float):
    """Block by block: the sets that may still match, their shared tokens by (frequency, token)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows = None, []

        def done() -> pa.RecordBatch | None:
            ids, sizes = next((np.frombuffer(r[3], "<i8"), np.frombuffer(r[4], "<u4").astype(np.int64)) for r in rows if r[2] == 0)
            told = [r for r in rows if r[2] == 1]
            if not told:
                return None
            tokens = np.concatenate([unpack40(r[3]) | np.uint64(r[0]) << np.uint64(40) for r in told])
            docs = np.concatenate([np.repeat(np.arange(len(ids)), np.frombuffer(r[4], "<u4")) for r in told])
            dfs = np.concatenate([np.frombuffer(r[5], "<u2") for r in told]).astype(np.int32)
            shared = np.bincount(docs, minlength=len(ids))
            on = (sizes > 0) & (shared >= np.ceil(threshold * sizes - 1e-9))
            mine = on[docs]
            tokens, docs, dfs = tokens[mine], docs[mine], dfs[mine]
            order = np.lexsort((tokens, dfs, docs))
            tokens, docs, dfs = tokens[order], docs[order], dfs[order]
            some = np.flatnonzero(on)
            if not len(some):
                return None
            ends = np.searchsorted(docs, some, side="right")
            offsets = np.concatenate(([0], ends)).astype(np.int32)
            whole = np.add.reduceat(mix(tokens ^ _MIX), offsets[:-1]).view(np.int64)
            cols = [
                pa.array((np.int64(block) << 20) | some), pa.array(ids[some]), pa.array(sizes[some].astype(np.int32)),
                pa.array((sizes - shared)[some].astype(np.int32)), pa.array(whole),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens.view(np.int64))), pa.ListArray.from_arrays(pa.array(offsets), pa.array(dfs)),
            ]
            return pa.RecordBatch.from_arrays(cols, ["rec", "doc_id", "size", "unshared", "whole", "tokens", "dfs"])

        for b in batches:
            for r in zip(*(b.column(k).to_pylist() for k in range(6))):
                if r[1] != block:
                    if rows and (made := done()):
                        yield made
                    block, rows = r[1], []
                rows.append(r)
        if rows and (made := done()):
            yield made

    return run


#: The largest size class whose tokens are rare up to ``rare_df``.
_RARE_CLASS = 8


def subclasses(g: int) -> int:
    """How many subclasses the frequent tokens of size class ``g`` (2^g to 2^(g+1) - 1 tokens) fall into."""
    return max(1, (1 << g) // 5 if g >= 4 else 1)


def rare_limit(g: int, rare_df: int) -> int:
    """Up to what frequency tokens are indexed alone in size class ``g``: a set of twice as many has twice as many entries, and others' sets to verify are twice as large."""
    return max(1, rare_df >> 2 * max(0, g - _RARE_CLASS))


def index_entries(tokens: np.ndarray, dfs: np.ndarray, size: int, unshared: int, threshold: float, rare_df: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashed entries of one set, its rare tokens and pairs of frequent ones in the extended prefix, and each one's slack.

    The slack is how many tokens a set must be allowed to lose for the entry to lie within its prefix.
    """
    need = size - math.ceil(threshold * size - 1e-9) + 1 - unshared
    if size < 2 or need < 1:
        return np.empty(0, np.uint64), np.empty(0, np.int32)
    g = size.bit_length() - 1
    classes = [g, g + 1] if math.floor(size / threshold + 1e-9) >> (g + 1) else [g]
    out, slack = [], []
    for k in classes:
        rare = int(np.searchsorted(dfs, rare_limit(k, rare_df), side="right"))
        salt = np.uint64((k + 1) * int(_MIX) & 0xFFFFFFFFFFFFFFFF)
        singles = tokens[: min(rare, need)]
        out.append(mix(singles ^ salt))
        slack.append(np.arange(len(singles)) + unshared)
        left = need - len(singles)
        if left <= 0:
            continue
        often = tokens[rare:]
        sub = (mix(often ^ np.uint64(0xA5A5)) % np.uint64(subclasses(k))).astype(np.int64)
        order = np.argsort(sub, kind="stable")
        first = np.zeros(len(often), dtype=bool)
        first[order[np.flatnonzero(np.concatenate(([True], np.diff(sub[order]) != 0)))]] = len(often) > 0
        gained = np.cumsum(~first)
        cut = int(np.searchsorted(gained, left)) + 1
        level = rare + unshared + np.concatenate(([0], gained))[: len(often)]
        often, sub, level = often[:cut], sub[:cut], level[:cut]
        order = np.argsort(sub, kind="stable")
        often, sub, level = often[order], sub[order], level[order]
        for gap in range(1, len(often)):
            pair = np.flatnonzero(sub[gap:] == sub[:-gap])
            if not len(pair):
                break
            x, y = often[pair], often[pair + gap]
            out.append(mix(mix(np.minimum(x, y) ^ salt) + np.maximum(x, y) * _MIX))
            slack.append(np.maximum(level[pair], level[pair + gap]))
    return np.concatenate(out), np.concatenate(slack).astype(np.int32)


def _index(threshold: float, rare_df: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list[np.ndarray]] = [[], [], [], []]
            for rec, size, unshared, tokens, dfs in zip(*(b.column(k).to_pylist() for k in range(3)), b.column(3), b.column(4)):
                e, slack = index_entries(tokens.values.to_numpy().view(np.uint64), dfs.values.to_numpy(), size, unshared, threshold, rare_df)
                for c, x in zip(cols, (e.view(np.int64), np.full(len(e), rec, np.int64), np.full(len(e), size, np.int32), slack)):
                    c.append(x)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in cols], ["sig", "rec", "size", "slack"])

    return run


_RUN_ROWS, _PAIR_ROWS = 1 << 18, 1 << 20


_PAIRS_SQL = "bucket int, kind int, n int, data binary"
#: Entries of up to so many sets are paired; beyond, their sets are a group's. Rare tokens are never beyond.
HEAVY_RUN = 32


def _pack_pairs(a: np.ndarray, b: np.ndarray) -> bytes:
    """Sorted pairs as the differences from one to the next, byte by byte, compressed."""
    steps = np.concatenate((np.diff(a, prepend=0), np.diff(b, prepend=0))).astype("<i8")
    return zstandard.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpack_pairs(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(8, -1).T
    steps = np.ascontiguousarray(raw).view("<i8").reshape(-1)
    return np.cumsum(steps[:n]), np.cumsum(steps[n:])


def _unique(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs, sorted."""
    a, b = (np.concatenate(x) for x in zip(*found))
    recs, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    keys = np.unique(at[: len(a)] << 32 | at[len(a) :])
    return recs[keys >> 32], recs[keys & 0xFFFFFFFF]


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket by bucket and kind by kind, the distinct pairs of its packets."""
    of, found = None, []

    def told() -> pa.RecordBatch:
        a, b = _unique(found)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), of[1], np.int32)), pa.array(a), pa.array(b)], ["kind", "a", "b"])

    for batch in batches:
        for k, kind, n, data in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if (k, kind) != of:
                if found:
                    yield told()
                of, found = (k, kind), []
            found.append(_unpack_pairs(data, n))
    if found:
        yield told()


def _pairs(threshold: float, buckets: int, heavy: int):
    """Runs of equal entries, by size within them, to candidate pairs (kind 0), packed for each bucket.

    Two sets must share ``ceil(t / (1 + t) (|x| + |y|))`` tokens; an entry counts for the pair only if it lies in both
    prefixes for the losses that this leaves. Pairs come once for each ``_PAIR_ROWS`` found. Runs of more than ``heavy`` sets
    of sizes that follow one another give a link (kind 1) from each set to the least instead.
    """
    share = threshold / (1 + threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
        held = [0, 0]

        def told(kind: int) -> pa.RecordBatch:
            a, b = _unique(found[kind])
            found[kind], held[kind] = [], 0
            to = (mix(a.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[order], np.arange(buckets + 1))
            out = [(k, kind, hi - lo, _pack_pairs(a[order[lo:hi]], b[order[lo:hi]])) for k, (lo, hi) in enumerate(pairwise(cuts.tolist())) if hi > lo]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.binary()))], ["bucket", "kind", "n", "data"])

        def add(kind: int, x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(x):
                found[kind].append((np.minimum(x, y), np.maximum(x, y)))
                held[kind] += len(x)
                if held[kind] > _PAIR_ROWS:
                    yield told(kind)

        def useful(sig: np.ndarray, size: np.ndarray, slack: np.ndarray) -> np.ndarray:
            """Whether an entry counts beside the smallest set of its run that is not too small."""
            run = np.cumsum(np.concatenate(([0], sig[1:] != sig[:-1]))) << 32  # runs are sorted by size
            least = size[np.searchsorted(run | size, run | np.ceil(threshold * size - 1e-9).astype(np.int64))]
            return size - np.ceil(share * (size.astype(np.int64) + least) - 1e-9) >= slack

        def made(sig: np.ndarray, rec: np.ndarray, size: np.ndarray, slack: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(sig):
                return
            on = useful(sig, size, slack)
            sig, rec, size, slack = sig[on], rec[on], size[on], slack[on]
            if not len(sig):
                return
            # no pair spans a step in sizes that is too large for the two beside it
            first = np.flatnonzero(np.concatenate(([True], (sig[1:] != sig[:-1]) | (size[:-1] < threshold * size[1:] - 1e-9))))
            many = np.diff(first, append=len(sig))
            last, long = np.repeat(first + many, many), np.repeat(many > heavy, many)
            if long.any():
                centre = np.repeat(np.minimum.reduceat(rec, first), many)
                link = long & (rec != centre)
                yield from add(1, centre[link], rec[link])
            gap, alive = 1, np.flatnonzero(~long)
            while len(alive):
                alive = alive[alive + gap < last[alive]]
                alive = alive[size[alive] >= threshold * size[alive + gap] - 1e-9]
                i, j = alive, alive + gap
                shared = np.ceil(share * (size[i].astype(np.int64) + size[j]) - 1e-9)
                ok = (size[i] - shared >= slack[i]) & (size[j] - shared >= slack[j]) & (rec[i] != rec[j])
                yield from add(0, rec[i[ok]], rec[j[ok]])
                gap += 1

        parts: list[pa.RecordBatch] = []
        rest = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32)]

        def joined() -> list[np.ndarray]:
            return [np.concatenate((r, *(p.column(k).to_numpy() for p in parts))) for k, r in enumerate(rest)]

        for b in batches:
            parts.append(b)
            if sum(p.num_rows for p in parts) >= _RUN_ROWS:
                now = joined()
                cut = int(np.searchsorted(now[0], now[0][-1]))  # the last run may go on
                yield from made(*(x[:cut] for x in now))
                rest, parts = [x[cut:] for x in now], []
        yield from made(*joined())
        for kind in (0, 1):
            if found[kind]:
                yield told(kind)

    return run


#: Tokens of one group of candidates that are brought together; larger groups are split and their parts paired.
UNIT_TOKENS = 1 << 20


def _verify(threshold: float):
    """Unit by unit, its sets and then its pairs: the pairs whose shared tokens suffice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = None
        sets: list[tuple[int, int, np.ndarray]] = []
        pairs: list[tuple[np.ndarray, np.ndarray]] = []

        def done() -> pa.RecordBatch | None:
            if not pairs:
                return None
            recs = np.array([r for r, _, _ in sets])
            order = np.argsort(recs)
            recs, held = recs[order], [sets[k] for k in order]
            sizes = np.array([z for _, z, _ in held], dtype=np.int64)
            ends = np.cumsum([len(t) for _, _, t in held])
            ids = np.unique(np.concatenate([t for _, _, t in held]), return_inverse=True)[1]
            tokens = np.split(ids, ends[:-1])
            a, b = (np.searchsorted(recs, np.concatenate(x)) for x in zip(*pairs))
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            common = np.empty(len(a), dtype=np.int64)
            mark = np.zeros(int(ids.max()) + 1, dtype=bool)
            cuts = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1], [True])))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                mine = tokens[a[lo]]
                mark[mine] = True
                for at in range(lo, hi, 4096):
                    others = [tokens[k] for k in b[at : min(hi, at + 4096)].tolist()]
                    starts = np.concatenate(([0], np.cumsum([len(o) for o in others])[:-1])).astype(np.int64)
                    common[at : at + len(others)] = np.add.reduceat(mark[np.concatenate(others)], starts, dtype=np.int64)
                mark[mine] = False
            jaccard = common / (sizes[a] + sizes[b] - common)
            ok = jaccard >= threshold - 1e-9
            return pa.RecordBatch.from_arrays([pa.array(recs[a[ok]]), pa.array(recs[b[ok]]), pa.array(jaccard[ok])], ["rep_a", "rep_b", "jaccard"])

        for batch in batches:
            units = batch.column(0).to_numpy()
            edges = np.flatnonzero(np.concatenate(([True], units[1:] != units[:-1], [True]))) if len(units) else [0]
            for lo, hi in zip(edges[:-1], edges[1:]):
                if unit is not None and units[lo] != unit:
                    if (made := done()) is not None:
                        yield made
                    sets, pairs = [], []
                unit = units[lo]
                part = batch.slice(lo, hi - lo)
                n = int((part.column(1).to_numpy() == 0).sum())  # sets come first
                a, size = part.column(2).to_numpy(), part.column(4).to_pylist()[:n]
                sets += [(int(r), z, t.values.to_numpy()) for r, z, t in zip(a[:n], size, part.column(5).slice(0, n))]
                if n < hi - lo:
                    pairs.append((a[n:], part.column(3).slice(n).to_numpy()))
        if unit is not None and (made := done()) is not None:
            yield made

    return run


#: Tokens of one block of a group, a set counting as ``_LEAST_TOKENS`` at least: 4096 sets or fewer.
TILE_TOKENS = 1 << 20
_LEAST_TOKENS = 256
#: Tokens that share this part of a tile's pairs or more are columns of a matrix; the others' pairs are listed, up to so many at once.
_DENSE, _LISTED, _TILE_ROWS = 64, 1 << 21, 256


def shared_tokens(left: list[np.ndarray], right: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """How many tokens each set of ``left`` shares with each of ``right``: the first row's number and some rows, in order."""
    a, b = (np.repeat(np.arange(len(x)), [len(t) for t in x]) for x in (left, right))
    at = np.unique(np.concatenate(left + right), return_inverse=True)[1]
    x, y = at[: len(a)], at[len(a) :]
    n = int(at.max(initial=-1)) + 1
    both = np.bincount(x, minlength=n) * (in_b := np.bincount(y, minlength=n))
    dense = both * _DENSE >= len(left) * len(right)
    column, some = np.cumsum(dense) - 1, (both > 0) & ~dense
    matrix = np.zeros((len(right), int(dense.sum())), dtype=np.float32)
    matrix[b[dense[y]], column[y[dense[y]]]] = 1
    a_dense, x_dense = a[dense[x]], column[x[dense[x]]]
    a, x, b, y = a[some[x]], x[some[x]], b[some[y]], y[some[y]]
    b = b[np.argsort(y, kind="stable")]  # by token
    of = np.where(some, in_b, 0)
    start = np.cumsum(of) - of
    listed = np.concatenate(([0], np.cumsum(np.bincount(a, weights=of[x], minlength=len(left)).astype(np.int64))))
    lo = 0
    while lo < len(left):
        hi = max(lo + 1, min(lo + _TILE_ROWS, int(np.searchsorted(listed, listed[lo] + _LISTED, side="right")) - 1))
        here = slice(*np.searchsorted(a_dense, (lo, hi)))
        rows = np.zeros((hi - lo, matrix.shape[1]), dtype=np.float32)
        rows[a_dense[here] - lo, x_dense[here]] = 1
        common = (rows @ matrix.T).astype(np.float64)
        here = slice(*np.searchsorted(a, (lo, hi)))
        if here.stop > here.start:
            each = of[x[here]]
            place = np.arange(each.sum()) + np.repeat(start[x[here]] - np.cumsum(each) + each, each)
            common += np.bincount(np.repeat((a[here] - lo) * len(right), each) + b[place], minlength=common.size).reshape(common.shape)
        yield lo, common
        lo = hi


def forest(ok: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the matrix ``ok`` does, its rows numbered from 0 and its columns, if not the ``same``, from there on."""
    n = len(ok)
    seen_a, seen_b = np.zeros(n, bool), np.zeros(ok.shape[1], bool)
    roots, nodes = [], []
    for root in np.flatnonzero(ok.any(axis=1)).tolist():
        if seen_a[root]:
            continue
        seen_a[root], front = True, np.array([root])
        while len(front):
            if same:
                front = np.flatnonzero(ok[front].any(axis=0) & ~seen_a)
                new = front
            else:
                cols = np.flatnonzero(ok[front].any(axis=0) & ~seen_b)
                seen_b[cols] = True
                front = np.flatnonzero(ok[:, cols].any(axis=1) & ~seen_a)
                new = np.concatenate((front, cols + n))
            seen_a[front] = True
            roots.append(np.full(len(new), root))
            nodes.append(new)
    return (np.concatenate(roots), np.concatenate(nodes)) if roots else (np.empty(0, np.int64), np.empty(0, np.int64))


_TILE_SQL = "kind int, a bigint, b bigint, n bigint, jaccard double"


def _tile(threshold: float, listed: bool):
    """Unit by unit, the sets of one block or two. ``listed``: their pairs that reach the threshold (kind 2).

    Else for each set the documents that it is linked to, by ``k``, and its greatest index (kind 0), edges that connect what the pairs
    do (kind 1), and for each document that owns several sets how often they are linked, both ways (kind 3).
    """

    def told(kind: int, a: np.ndarray, b: np.ndarray | None = None, n: np.ndarray | None = None, jaccard: np.ndarray | None = None) -> pa.RecordBatch:
        none = np.zeros(len(a), np.int64)
        cols = [np.full(len(a), kind, np.int32), a, none if b is None else b, none if n is None else n, none.astype(float) if jaccard is None else jaccard]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["kind", "a", "b", "n", "jaccard"])

    def tile(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        sides = [[r for r in rows if r[0] == k] for k in (0, 1)]
        same = not sides[1]
        left, right = sides[0], sides[0] if same else sides[1]
        (recs_a, size_a, k_a), (recs_b, size_b, k_b) = (tuple(np.array([r[k] for r in x], dtype=np.int64) for k in (1, 2, 3)) for x in (left, right))
        ok = np.zeros((len(left), len(right)), dtype=bool)
        n_a, n_b, near_a, near_b = np.zeros(len(left)), np.zeros(len(right)), np.zeros(len(left)), np.zeros(len(right))
        for lo, common in shared_tokens([r[5] for r in left], [r[5] for r in right]):
            at = np.arange(lo, lo + len(common))
            jaccard = common / (size_a[at, None] + size_b - common)
            if same:
                jaccard[at - lo, at] = 0
            hit = ok[at] = jaccard >= threshold - 1e-9
            if listed:
                i, j = np.nonzero(np.triu(hit, lo + 1) if same else hit)
                yield told(2, recs_a[i + lo], recs_b[j], None, jaccard[i, j])
                continue
            jaccard[~hit] = 0
            n_a[at], near_a[at] = hit.astype(float) @ k_b, jaccard.max(axis=1)
            if not same:
                n_b += k_a[at] @ hit.astype(float)
                near_b = np.maximum(near_b, jaccard.max(axis=0))
        if listed:
            return
        for recs, n, near in ((recs_a, n_a, near_a), (recs_b, n_b, near_b)):
            yield told(0, recs[n > 0], None, n[n > 0].astype(np.int64), near[n > 0])
        root, node = forest(ok, same)
        yield told(1, recs_a[root], np.concatenate((recs_a, recs_b))[node])
        own: list[dict[int, list[int]]] = [{}, {}]
        for of, side in zip(own, (left, right)):
            for i, r in enumerate(side):
                for owner in r[4] or ():
                    of.setdefault(owner, []).append(i)
        counts = {x: int(ok[np.ix_(i, own[1][x])].sum()) * (1 if same else 2) for x, i in own[0].items() if x in own[1]}
        yield told(3, np.array(list(counts), dtype=np.int64), None, np.array(list(counts.values()), dtype=np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows = None, []
        for batch in batches:
            for u, *row, tokens in zip(*(batch.column(k).to_pylist() for k in range(6)), batch.column(6)):
                if u != unit:
                    if rows:
                        yield from tile(rows)
                    unit, rows = u, []
                rows.append((*row, tokens.values.to_numpy()))
        if rows:
            yield from tile(rows)

    return run


def _tiled(grouped: DataFrame, threshold: float, buckets: int, weights: DataFrame | None = None, owners: DataFrame | None = None, listed: bool = False) -> DataFrame:
    """What ``_tile`` tells of all groups in ``grouped``; ``weights`` has ``rep`` and ``k``, 1 where it has none, ``owners`` ``rep`` and ``owners``."""
    small = grouped.select("root", "rec", "size")
    room = F.greatest("size", F.lit(_LEAST_TOKENS)).cast("bigint")
    before = F.sum(room).over(Window.partitionBy("root").orderBy("size", "rec")) - room
    small = small.withColumn("block", F.floor(before / F.lit(TILE_TOKENS)))
    for more, name, none in ((weights, "k", F.lit(1)), (owners, "owners", F.lit(None).cast("array<bigint>"))):
        small = small.withColumn(name, none) if more is None else small.join(more.withColumnRenamed("rep", "rec"), "rec", "left")
    small = stash(small.withColumn("k", F.coalesce("k", F.lit(1)).cast("bigint")), "blocks")
    ends = small.groupBy("root", "block").agg(F.min("size").alias("lo"), F.max("size").alias("hi"))
    x, y = (ends.select("root", *[F.col(c).alias(f"{c}_{s}") for c in ("block", "lo", "hi")]) for s in "xy")
    units = stash(x.join(y, "root").filter(f"block_x <= block_y AND hi_x >= {threshold} * lo_y - 1e-9").select(F.monotonically_increasing_id().alias("unit"), "root", "block_x", "block_y"), "tiles")
    sides = units.select("unit", F.lit(0).alias("side"), "root", F.col("block_x").alias("block")).unionByName(units.filter("block_x < block_y").select("unit", F.lit(1).alias("side"), "root", F.col("block_y").alias("block")))
    held = small.drop("size").join(grouped.drop("root"), "rec").join(sides, ["root", "block"])
    ordered = held.select("unit", "side", "rec", "size", "k", "owners", "tokens").repartition(buckets, "unit").sortWithinPartitions("unit", "side")
    return stash(ordered.mapInArrow(lean(_tile(threshold, listed)), _TILE_SQL), "tiled")


def _some(ids: DataFrame) -> DataFrame:
    """``ids``, to be broadcast up to BROADCAST_IDS rows."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _where(df: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """``df`` semi- or anti-joined with ``ids``, which is broadcast up to BROADCAST_IDS rows."""
    return df.join(_some(ids), key, how)


def _verified(candidates: DataFrame, sets: DataFrame, threshold: float, buckets: int) -> DataFrame:
    """The candidate pairs (a, b) of ``sets`` that reach the threshold.

    A set's leader is its smallest candidate partner, or itself. The sets of one leader, in parts of about UNIT_TOKENS, go
    together, so that the members of a group of near duplicates travel once and not with each of their pairs.
    """
    both = candidates.select(F.col("a").alias("rec"), F.col("b").alias("other")).unionByName(candidates.select(F.col("b").alias("rec"), F.col("a").alias("other")))
    leaders = stash(both.groupBy("rec").agg(F.least(F.min("other"), F.col("rec")).alias("leader")), "leaders")
    some = _where(sets, leaders.select("rec"), "rec", "left_semi")
    led = leaders.join(some.select("rec", "size"), "rec")
    parts = led.groupBy("leader").agg(F.ceil(F.sum("size") / F.lit(UNIT_TOKENS)).alias("n_parts"))
    part = F.xxhash64("leader", F.pmod(F.xxhash64("rec"), F.col("n_parts")))
    placed = stash(led.join(parts, "leader").select("rec", part.alias("part")), "parts")
    side = lambda x: placed.select(F.col("rec").alias(x), F.col("part").alias(f"part_{x}"))
    unit = F.xxhash64(F.least("part_a", "part_b"), F.greatest("part_a", "part_b")).alias("unit")
    units = stash(candidates.join(side("a"), "a").join(side("b"), "b").select(unit, "a", "b"), "units")
    needed = units.select("unit", F.col("a").alias("rec")).unionByName(units.select("unit", F.col("b").alias("rec"))).distinct()
    held = needed.join(some.select("rec", "size", "tokens"), "rec").select("unit", F.lit(0).alias("kind"), F.col("rec").alias("a"), F.lit(0).cast("bigint").alias("b"), "size", "tokens")
    asked = units.select("unit", F.lit(1).alias("kind"), "a", "b", F.lit(0).alias("size"), F.lit(None).cast("array<bigint>").alias("tokens"))
    ordered = held.unionByName(asked).repartition(buckets, "unit").sortWithinPartitions("unit", "kind")
    return ordered.mapInArrow(lean(_verify(threshold)), "rep_a bigint, rep_b bigint, jaccard double")


def similar_sets(df: DataFrame, n: int = N, threshold: float = THRESHOLD, rare_df: int = RARE_DF, text_col: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(members, pairs): the documents of each distinct set that may match, and the pairs of sets that do.

    ``members`` has ``rep`` and ``doc_id``; ``pairs`` has ``rep_a``, ``rep_b`` and ``jaccard``. Both are tables in the shared folder.
    All pairs are listed, those of groups too, whose number grows with their square; ``links`` and ``keep_one`` do not list these.
    """
    members, pairs, grouped, buckets = _similar(df, n, threshold, rare_df, text_col, id_col)
    if grouped is None:
        return members, pairs
    more = _tiled(grouped, threshold, buckets, listed=True)
    return members, pairs.unionByName(more.select(F.col("a").alias("rep_a"), F.col("b").alias("rep_b"), "jaccard"))


def _similar(df: DataFrame, n: int, threshold: float, rare_df: int, text_col: str, id_col: str) -> tuple[DataFrame, DataFrame, DataFrame | None, int]:
    """(members, pairs, grouped, buckets): as ``similar_sets``, but pairs within a group are not among ``pairs``.

    ``grouped`` has ``root``, the group's number, and ``rec``, ``size`` and ``tokens`` of the sets in groups; None without groups.
    """
    if not 0.5 < threshold <= 1 or n < 1 or rare_df < 2:
        raise ValueError("threshold must be over 0.5 and at most 1, n at least 1, rare_df at least 2")
    df = tidy(df)
    docs = df.filter(col(id_col).isNotNull()).select(col(id_col).cast("bigint").alias("doc_id"), col(text_col).alias("text"))
    docs = stable(docs)
    buckets = buckets_for(docs, "text")
    told = docs.mapInArrow(lean(_spread(n, buckets)), _SCHEMA).repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket")
    back = told.mapInArrow(lean(_count), _SCHEMA).repartition(buckets, "block").sortWithinPartitions("block")
    sets = stash(back.mapInArrow(lean(_gather(threshold)), _SETS), "sets")
    key = ["whole", "size"]
    reps = sets.filter("unshared = 0").groupBy(*key).agg(F.min("rec").alias("rep"))
    equal = sets.filter("unshared = 0").select("rec", "doc_id", *key).join(reps, key)
    members = equal.select("rec", "rep", "doc_id").unionByName(sets.filter("unshared > 0").select("rec", F.col("rec").alias("rep"), "doc_id"))
    members = stash(members, "set-members")
    one = _where(sets, members.filter("rec <> rep").select("rec"), "rec", "left_anti")
    entries = one.select("rec", "size", "unshared", "tokens", "dfs").mapInArrow(lean(_index(threshold, rare_df)), "sig bigint, rec bigint, size int, slack int")
    runs = entries.repartition(buckets, "sig").sortWithinPartitions("sig", "size", "rec")
    packets = runs.mapInArrow(lean(_pairs(threshold, buckets, HEAVY_RUN)), _PAIRS_SQL).repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "kind")
    found = stash(packets.mapInArrow(lean(_distinct), "kind int, a bigint, b bigint"), "candidates")
    candidates, heavy, grouped = found.filter("kind = 0").select("a", "b"), found.filter("kind = 1"), None
    if not heavy.isEmpty():
        groups = stash(components(heavy, "a", "b"), "groups")
        side = lambda x: groups.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
        apart = candidates.join(side("a"), "a", "left").join(side("b"), "b", "left").filter("NOT root_a <=> root_b OR root_a IS NULL")
        candidates = stash(apart.select("a", "b"), "apart")
        grouped = stash(one.select("rec", "size", "tokens").join(groups.withColumnRenamed("node", "rec"), "rec"), "grouped")
    return members.select("rep", "doc_id"), stash(_verified(candidates, one, threshold, buckets), "set-pairs"), grouped, buckets


def components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """``node`` and ``root``, the smallest node of its connected component, of all nodes in ``edges``.

    Alternates large-star and small-star steps, each a table in the shared folder, until the edges no longer change.
    """
    e = stash(edges.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b")).distinct(), "star")

    def mark(x: DataFrame) -> tuple:
        return tuple(x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = mark(e)
    while True:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        e = stash(small.filter("a <> b").distinct(), "star")
        after = mark(e)
        if after == before:
            break
        before = after
    roots = e.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _edges(tiled: DataFrame) -> DataFrame:
    """The edges that connect what the pairs of groups do."""
    return tiled.filter("kind = 1").select(F.col("a").alias("rep_a"), F.col("b").alias("rep_b"))


def _classes(members: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``doc_id``, ``rep``; ``rep``, ``class_id``) of all documents in ``members``: their sets and the sets' classes.

    Sets are of one class if pairs, or documents that have several texts, link them by however many steps.
    """
    one = members.groupBy("doc_id").agg(F.min("rep").alias("first"))
    several = members.join(one, "doc_id").filter("rep <> first").select(F.col("first").alias("rep_a"), F.col("rep").alias("rep_b"))
    roots = components(pairs.select("rep_a", "rep_b").unionByName(several), "rep_a", "rep_b").withColumnRenamed("node", "rep")
    group = stash(members.join(roots, "rep", "left").select("doc_id", "rep", F.coalesce("root", "rep").alias("root")), "classed")
    return group, group.groupBy("root").agg(F.min("doc_id").alias("class_id"))


def links(df: DataFrame, n: int = N, threshold: float = THRESHOLD, rare_df: int = RARE_DF, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row a document: ``doc_id``, ``class_id``, ``n_links``, ``max_jaccard``.

    Two documents are linked if the Jaccard index of their n-gram sets reaches ``threshold``; ``n_links`` counts all documents
    that a document is linked to, ``max_jaccard`` is the greatest index of its texts with any other, null without links. Links form classes, by however many steps;
    ``class_id`` is the smallest id of the class. Pairs of different sets are all found and counted, but not listed: a class of m
    documents has m rows. Documents of equal sets are linked by index 1 without being paired.

    Rows with a null id have no row. Ids are integers, or strings of integers; any other string is an error. Texts that are null or without a word are linked to nothing, not even to each other.
    A text of fewer than ``n`` words has one token, itself. Repeated rows of one id count once, and an id is not linked to
    itself; an id with several different texts is one document of the class of all of them and has the links of each. Other columns are not read.
    """
    df = tidy(df)
    members, pairs, grouped, buckets = _similar(df, n, threshold, rare_df, text_col, id_col)
    members = stash(members.distinct(), "members")
    several = _some(members.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("doc_id"))
    equal = _some(members.groupBy("rep").agg(F.count(F.lit(1)).alias("k")).filter("k > 1"))
    edges, tiled = pairs.select("rep_a", "rep_b"), None
    if grouped is not None:
        owners = members.join(several, "doc_id", "left_semi").groupBy("rep").agg(F.collect_list("doc_id").alias("owners"))
        tiled = _tiled(grouped, threshold, buckets, equal, owners)
        edges = edges.unionByName(_edges(tiled))
    group, classes = _classes(members, edges)
    both = pairs.select("rep_a", "rep_b", "jaccard").unionByName(pairs.select(F.col("rep_b").alias("rep_a"), F.col("rep_a").alias("rep_b"), "jaccard"))
    each = both.join(equal.withColumnRenamed("rep", "rep_b"), "rep_b", "left").select("rep_a", F.coalesce("k", F.lit(1)).cast("bigint").alias("n"), "jaccard")
    if tiled is not None:
        each = each.unionByName(tiled.filter("kind = 0").select(F.col("a").alias("rep_a"), "n", "jaccard"))
    weighed = each.groupBy("rep_a").agg(F.sum("n").alias("others"), F.max("jaccard").alias("near"))
    sets = group.join(weighed.withColumnRenamed("rep_a", "rep"), "rep", "left").join(equal, "rep", "left")
    # an id whose own texts are linked is not linked to itself
    own = members.join(several, "doc_id", "left_semi")
    own = both.join(own.select(F.col("rep").alias("rep_a"), "doc_id"), "rep_a").join(own.select(F.col("rep").alias("rep_b"), "doc_id"), ["rep_b", "doc_id"]).select("doc_id", F.lit(1).cast("bigint").alias("n"))
    if tiled is not None:
        own = own.unionByName(tiled.filter("kind = 3").select(F.col("a").alias("doc_id"), "n"))
    own = own.groupBy("doc_id").agg(F.sum("n").alias("own"))
    told = sets.join(classes, "root").groupBy("doc_id").agg(
        F.first("class_id").alias("class_id"),
        F.sum(F.coalesce("others", F.lit(0)) + F.coalesce("k", F.lit(1)) - 1).alias("links"),
        F.max(F.when(F.col("k") > 1, F.lit(1.0)).otherwise(F.col("near"))).alias("max_jaccard"),
    )
    told = told.join(own, "doc_id", "left").select("doc_id", "class_id", (F.col("links") - F.coalesce("own", F.lit(0))).alias("links"), "max_jaccard")
    ids = df.select(col(id_col).cast("bigint").alias("doc_id")).filter("doc_id IS NOT NULL").distinct()
    linked = F.coalesce("links", F.lit(0)).cast("bigint")
    return ids.join(told, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), linked.alias("n_links"), F.when(linked > 0, F.col("max_jaccard")).alias("max_jaccard"))


def keep_one(df: DataFrame, n: int = N, threshold: float = THRESHOLD, rare_df: int = RARE_DF, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``df`` less those of documents that are linked, by similar pairs, to one of smaller id.

    Documents that pairs link, directly or by way of others, are a class; that of smallest id stays. Ids are integers, or strings of integers; any other string is an error. Rows with a null id and
    texts without a word stay. Of repeated rows of one id all stay or all go; an id with several texts is of the class of all of them.
    """
    df = tidy(df, ("__gone",))
    members, pairs, grouped, buckets = _similar(df, n, threshold, rare_df, text_col, id_col)
    edges = pairs.select("rep_a", "rep_b")
    if grouped is not None:
        edges = edges.unionByName(_edges(_tiled(grouped, threshold, buckets)))
    group, classes = _classes(members.distinct(), edges)
    gone = _some(stash(group.join(classes, "root").filter("doc_id <> class_id").select(F.col("doc_id").alias("__gone")).distinct(), "gone"))
    return df.join(gone, col(id_col).cast("bigint") == F.col("__gone"), "left_anti")


def oracle(n: int = N, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for ``links`` on documents, whose ids are unique."""
    gram = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
    return rf"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
g AS (SELECT DISTINCT doc_id, {gram} AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM t WHERE len(w) >= {n})
  UNION ALL SELECT DISTINCT doc_id, array_to_string(w, ' ') FROM t WHERE len(w) BETWEEN 1 AND {n - 1}),
s AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
o AS (SELECT x.doc_id AS doc_a, y.doc_id AS doc_b, count(*) AS o FROM g x JOIN g y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
p AS MATERIALIZED (SELECT doc_a, doc_b, o.o / CAST(a.n + b.n - o.o AS DOUBLE) AS jaccard FROM o JOIN s a ON a.doc_id = doc_a JOIN s b ON b.doc_id = doc_b
  WHERE o.o >= {threshold} * (a.n + b.n - o.o) - 1e-9),
l AS MATERIALIZED (SELECT doc_a AS a, doc_b AS b, jaccard FROM p UNION ALL SELECT doc_b, doc_a, jaccard FROM p),
r AS (SELECT DISTINCT a AS doc_id, a AS other FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other),
c AS (SELECT doc_id, min(other) AS class_id FROM r GROUP BY 1),
k AS (SELECT a AS doc_id, count(*) AS n, max(jaccard) AS best FROM l GROUP BY 1)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, k.best AS max_jaccard
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)"""
