"""Byte-level BPE over a corpus: every distinct pre-token is encoded once.

Encoding takes four steps. (1) Each block of documents is cut at spaces and its distinct pieces into pre-tokens; the distinct
ones get numbers, the frequent ones the small ones, and every document becomes its pre-tokens'
numbers in order of position. (2) The distinct pre-tokens of all blocks are exchanged by hash, so
that all blocks' copies of one meet in one place. (3) There each distinct one is encoded once and
its ids go back to the blocks that hold it. (4) Block by block, the documents' positions look up the
ids and are strung together. What moves is one copy of a pre-token for each block and one to two bytes a
position, in place of a row for each pre-token. Decoding joins the table of tokens' bytes.
"""

from __future__ import annotations

import base64
import re
import sys
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buckets_for, col, lean, stable, tidy

#: The pre-token pattern of the 50k byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for texts without the characters of ``_odd``.
_FAST = r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
#: Most tokens a vocabulary may have to be broadcast for decoding.
BROADCAST_TOKENS = 2_000_000
#: Tokens that are decoded at a time.
SLICE = 500_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=1)
def _odd() -> re.Pattern:
    """Characters on which the fast pattern and the exact one may differ."""
    odd = [0x1C, 0x1D, 0x1E, 0x1F]
    for i in range(sys.maxunicode + 1):
        if (k := unicodedata.category(chr(i))) in ("No", "Nl", "Cn", "Co", "Cs"):
            odd.append(i)
    spans, start = [], None
    for a, b in pairwise([*odd, -1]):
        start = a if start is None else start
        if b != a + 1:
            spans.append(f"\\U{start:08x}-\\U{a:08x}")
            start = None
    return re.compile("[" + "".join(spans) + "]")


@lru_cache(maxsize=1)
def _patterns() -> tuple[re.Pattern, regex.Pattern]:
    return re.compile(_FAST), regex.compile(PATTERN)


def pre_tokens(text: str) -> list[str]:
    """The text cut by PATTERN; joined together they are the text again."""
    fast, exact = _patterns()
    return (exact if _odd().search(text) else fast).findall(text)


_SPACES = tuple(chr(c) for c in range(0x3001) if chr(c).isspace())
_ASCII_SPACES = tuple(c for c in _SPACES if c.isascii())


def pieces_of(text: str) -> list[str]:
    """The text cut at spaces so that each piece can be pre-tokenised alone, all but the first with a space before it.

    A pre-token never goes on over a space that follows something else than white space, and never looks beyond its end
    unless it is white space. Pieces that end with white space are therefore joined with the next one.
    """
    pieces = text.split(" ")
    if text[:1] != " " and not any(c in text and c + " " in text for c in (_ASCII_SPACES if text.isascii() else _SPACES)):
        return pieces
    out, now = [], None
    for p in pieces:
        now = p if now is None else f"{now} {p}"
        if now and not now[-1].isspace():
            out.append(now)
            now = None
    return out if now is None else [*out, now]


_MARKS = frozenset(".,;:!?")


def cut_piece(piece: str, before: str) -> list[str]:
    """``pre_tokens(before + piece)``, with short ways for a word and a word with a mark behind it; ``before`` is '' or a space."""
    if piece.isalpha():
        return [before + piece]
    if piece[-1:] in _MARKS and piece[:-1].isalpha():
        return [before + piece[:-1], piece[-1]]
    return pre_tokens(before + piece)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """BPE of one pre-token: the adjacent pair of least rank merges, the leftmost first, until none is known.

    The plain statement of the algorithm; ``encoder`` uses the library that does the same faster.
    """
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, i = min(((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(pairwise(parts))))
        if rank == 1 << 60:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


@lru_cache(maxsize=2)
def encoding(path: str):
    """The library's tokenizer of a vocabulary, without special tokens, made once for each process."""
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})


#: PATTERN for texts without two white spaces in a row, where looking ahead changes nothing.
_SINGLE = PATTERN.replace(r"|\s+(?!\S)", "")


@lru_cache(maxsize=2)
def text_encoder(path: str) -> Callable[[str], list[int]]:
    """A function from a text to its ids, by the library; texts without two white spaces in a row go by a pattern that does not look ahead."""
    import tiktoken

    exact = encoding(path).encode_ordinary
    single = tiktoken.Encoding("own-single", pat_str=_SINGLE, mergeable_ranks=load_ranks(path), special_tokens={}).encode_ordinary
    pairs, ascii_spaces = ("  ", "\n\n", " \n", "\n "), [c for c in _ASCII_SPACES if c not in " \n"]
    spaces = [c for c in _SPACES if c not in " \n"]

    def ids(text: str) -> list[int]:
        double = any(p in text for p in pairs) or any(c in text for c in (ascii_spaces if text.isascii() else spaces))
        return exact(text) if double else single(text)

    return ids


def encoder(path: str):
    """A function from a pre-token's bytes to its ids."""
    return encoding(path)._core_bpe.encode_single_piece


#: Texts that ``encode``, ``encode_rows`` and ``count_rows`` hold the ids of at a time.
TEXTS = 1000


def _pack(numbers: np.ndarray) -> bytes:
    """Small numbers in one to four bytes each, by way of UTF-8; larger ones in four."""
    if len(numbers) and int(numbers.max()) > 0x10FFFF:
        return b"\1" + numbers.astype("<u4").tobytes()
    return b"\0" + numbers.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")


def _unpack(data: bytes) -> np.ndarray:
    raw = data[1:] if data[:1] == b"\1" else data[1:].decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass")
    return np.frombuffer(raw, dtype="<u4").astype(np.int64)


#: A block of documents ends when it has so many distinct pre-tokens.
BLOCK_WORDS = 500_000


class _Numbers(dict):
    """Numbers what it is asked for as it comes."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _expand(numbers: np.ndarray, starts: np.ndarray, counts: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """``flat[starts[n] : starts[n] + counts[n]]`` for all ``numbers`` n, strung together."""
    many = counts[numbers]
    ends = np.cumsum(many)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    return flat[np.arange(ends[-1]) + np.repeat(starts[numbers] - (ends - many), many)]


def _finish(heads: dict, rests: dict, docs: list[np.ndarray | None]) -> tuple[list, list[str]]:
    """A block's documents, given as the numbers of their pieces (those of first ones negative), as numbers of pre-tokens; clears the pieces."""
    words = _Numbers()
    flat_, counts_ = array("i"), array("i")
    for known, before in ((rests, " "), (list(reversed(heads)), "")):
        for p in known:
            found = cut_piece(p, before)
            counts_.append(len(found))
            flat_.extend(map(words.__getitem__, found))
    heads.clear()
    rests.clear()
    flat, counts = np.array(flat_, dtype=np.int32), np.array(counts_, dtype=np.int64)
    starts = np.cumsum(counts) - counts
    # the piece -1 - k is the first one's number k, which stands k places from the end
    numbers = [None if d is None else _expand(np.where(d < 0, len(counts) + d, d), starts, counts, flat) for d in docs]
    some = [d for d in numbers if d is not None]
    often = np.bincount(np.concatenate(some), minlength=len(words)) if some else np.zeros(len(words), np.int64)
    order = np.argsort(-often, kind="stable")
    place = np.empty(len(words), dtype=np.int32)
    place[order] = np.arange(len(words))
    known = list(words)
    return [d if d is None else place[d] for d in numbers], [known[n] for n in order.tolist()]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list, list[str]]]:
    """(block, ids, numbers of each document's pre-tokens or None, words by number); the same at each attempt."""
    part, made = TaskContext.get().partitionId(), 0
    for batch in batches:
        heads, rests, ids, docs, end = _Numbers(), _Numbers(), [], [], batch.num_rows
        for row, (i, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1)), 1):
            t = t.as_py()
            ids.append(i)
            if t is None:
                docs.append(None)
            else:
                pieces = pieces_of(t)
                pieces[0], first = "", heads[pieces[0]]
                numbers = np.fromiter(map(rests.__getitem__, pieces), dtype=np.int32, count=len(pieces))
                numbers[0] = -1 - first
                docs.append(numbers)
            if len(rests) > BLOCK_WORDS or row == end:
                block = (part << 24 | made, ids, *_finish(heads, rests, docs))
                heads, rests, ids, docs, made = _Numbers(), _Numbers(), [], [], made + 1
                yield block
                del block


_WORDS = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("chars", pa.binary()), ("lens", pa.binary()), ("nums", pa.binary())])
_ROWS = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
_ROWS_SQL = "block bigint, kind int, doc_id bigint, a binary, b binary, c binary"


def encode(df: DataFrame, vocabulary: str | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row a document: ``doc_id``, ``token_ids`` (array<int>), ``n_tokens``.

    A null text has null ``token_ids`` and ``n_tokens``, an empty one has no tokens. Null ids and
    repeated rows are kept, each with its own row. Ids are integers, or strings of integers; any other string is an error. Special tokens' strings are ordinary text.
    Other columns are not read. ``vocabulary`` is the path of a file of base64 tokens and ranks that
    every executor can read.
    """
    path = vocabulary or default_vocabulary()
    docs = stable(tidy(df).select(col(id_col).cast("bigint").alias("doc_id"), col(text_col).alias("text")))

    buckets = buckets_for(docs, "text")

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, _, words in _blocks(batches):
            raw = [w.encode("utf-8", "surrogatepass") for w in words]
            where = np.fromiter((zlib.crc32(w) % buckets for w in raw), dtype=np.int64, count=len(raw))
            order = np.argsort(where, kind="stable")
            lens = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
            cuts = np.searchsorted(where[order], np.arange(buckets + 1))
            out = []
            for b in range(buckets):
                here = order[cuts[b] : cuts[b + 1]]
                if len(here):
                    out.append((b, block, b"".join([raw[i] for i in here]), _pack(lens[here]), _pack(here)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), _WORDS)], schema=_WORDS)

    def docs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, docs_, _ in _blocks(batches):
            n = len(ids)
            cols = [[block] * n, [1] * n, ids, [None if d is None else _pack(d) for d in docs_], [None] * n, [None] * n]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, _ROWS)], schema=_ROWS)

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, now, known = encoder(path), -1, {}
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["bucket"] != now:
                    now, known = r["bucket"], {}
                ends = np.cumsum(_unpack(r["lens"])).tolist()
                ids, counts, at = [], [], 0
                for e in ends:
                    w = r["chars"][at:e]
                    got = known.get(w)
                    if got is None:
                        got = known[w] = piece(w)
                    ids += got
                    counts.append(len(got))
                    at = e
                out.append((r["block"], 0, None, r["nums"], _pack(np.array(counts)), _pack(np.array(ids))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), _ROWS)], schema=_ROWS)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, table = None, [], None
        for batch in (b.slice(at, TEXTS) for b in batches for at in range(0, b.num_rows, TEXTS)):
            ids, lists = [], []
            for block, kind, doc, a, b, c in zip(*(batch.column(k) for k in range(6))):
                block = block.as_py()
                if block != now:
                    now, parts, table = block, [], None
                if kind.as_py() == 0:
                    parts.append((_unpack(a.as_py()), _unpack(b.as_py()), _unpack(c.as_py())))
                    continue
                table = table or _Lookup(parts)
                ids.append(doc.as_py())
                a = a.as_py()
                lists.append(None if a is None else table.ids(_unpack(a)))
            if ids:
                lens = [0 if x is None else len(x) for x in lists]
                flat = np.concatenate([x for x in lists if x is not None]) if any(lens) else np.empty(0, np.int32)
                offsets = pa.array(np.concatenate(([0], np.cumsum(lens))).astype(np.int32))
                mask = pa.array([x is None for x in lists])
                tokens = pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()), mask=mask)
                n = pa.array([None if x is None else len(x) for x in lists], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), tokens, n], ["doc_id", "token_ids", "n_tokens"])

    words = docs.mapInArrow(lean(words_of), "bucket int, block bigint, chars binary, lens binary, nums binary")
    answers = words.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(encode_words), _ROWS_SQL)
    rows = docs.mapInArrow(lean(docs_of), _ROWS_SQL).unionByName(answers)
    joined = rows.repartition("block").sortWithinPartitions("block", "kind")
    return joined.mapInArrow(lean(assemble), "doc_id bigint, token_ids array<int>, n_tokens int")


class _Lookup:
    """From a block's pre-token numbers to ids."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        self.flat = np.concatenate([p[2] for p in parts]).astype(np.int32) if parts else np.empty(0, np.int32)
        n = sum(len(p[0]) for p in parts)
        self.start, self.count = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        base = 0
        for nums, counts, ids in parts:
            self.start[nums] = base + np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64)[: len(nums)]
            self.count[nums] = counts
            base += len(ids)

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        return _expand(numbers, self.start, self.count, self.flat)


def token_table(spark: SparkSession, vocabulary: str | None = None) -> DataFrame:
    """``id`` and ``bytes`` of every token."""
    ranks = load_ranks(vocabulary or default_vocabulary())
    return spark.createDataFrame([(i, b) for b, i in ranks.items()], "id int, bytes binary")


def joined(tokens: DataFrame) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]] | None:
    """A step from lists of ids to their tokens' bytes strung together, as ``decode`` takes it; None if ids repeat, lie far apart or are too many to be broadcast."""
    if tokens.count() > BROADCAST_TOKENS:
        return None
    found = tokens.select("id", "bytes").filter("id IS NOT NULL").collect()
    known = {r[0]: r[1] for r in found}
    low, high = min(known, default=0), max(known, default=0)
    if len(known) < len(found) or high - low >= 4 * BROADCAST_TOKENS:
        return None
    missing = len(known)
    slots = np.full(high - low + 1, missing, dtype=np.int32)
    slots[np.fromiter(known, np.int64, missing) - low] = np.arange(missing)
    table = pa.array([*("\ufffd".encode() if b is None else bytes(b) for b in known.values()), "\ufffd".encode()], pa.binary())
    shared = tokens.sparkSession.sparkContext.broadcast((slots, table))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        slots, table = shared.value
        for lists in batches:
            offsets = lists.offsets.to_numpy().astype(np.int64)
            ends, texts, size = [np.zeros(1, np.int64)], [], 0
            row = 0
            while row < len(lists):  # whole lists of SLICE tokens in all, or one longer list
                end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, side="right")) - 1)
                ids = lists.values[offsets[row] : offsets[end]].cast(pa.int64())
                at = ids.fill_null(low - 1).to_numpy() - low
                at = np.where((at >= 0) & (at < len(slots)), slots[np.clip(at, 0, len(slots) - 1)], np.int32(missing))
                taken = table.take(pa.array(at, pa.int32()))
                if len(taken):
                    places = np.frombuffer(taken.buffers()[1], np.int32, len(taken) + 1)
                    texts.append(taken.buffers()[2].to_pybytes()[: places[-1]])
                    ends.append(size + places[offsets[row + 1 : end + 1] - offsets[row]])
                    size += len(texts[-1])
                else:
                    ends.append(np.full(end - row, size))
                row = end
            ends = pa.py_buffer(np.concatenate(ends).astype(np.int32))
            out = pa.BinaryArray.from_buffers(pa.binary(), len(lists), [None, ends, pa.py_buffer(b"".join(texts))])
            yield pc.if_else(lists.is_valid(), out, pa.scalar(None, pa.binary())) if lists.null_count else out

    return run


def decode(df: DataFrame, tokens: DataFrame, ids_col: str = "token_ids") -> DataFrame:
    """All rows with ``decoded``: the text of ``ids_col``, by a join with the table of tokens' bytes.

    A table of up to BROADCAST_TOKENS rows is broadcast and joined list by list, without a row for each token and
    without an exchange; a larger one, or one that repeats ids, is joined token by token and shuffled. Null ``ids_col`` gives null,
    an empty one ''. Null ids in the list and ids that the table lacks become U+FFFD, and so do bytes that are
    no UTF-8. Repeated rows are kept apart. An input column ``decoded`` is kept as ``decoded_in``.
    """
    df = tidy(df, ("decoded", "__row"), keep=(ids_col,))
    if run := joined(tokens):

        @F.arrow_udf("binary")
        def text_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            yield from lean(run)(batches)

        return df.withColumn("decoded", F.make_valid_utf8(text_of(col(ids_col)).cast("string")))
    df = stable(df)
    rows = df.withColumn("__row", F.monotonically_increasing_id())
    table = tokens.select(F.col("id").alias("__id"), F.hex("bytes").alias("__hex"))
    if table.count() <= BROADCAST_TOKENS:
        table = F.broadcast(table)
    places = rows.select("__row", F.posexplode(col(ids_col)).alias("__pos", "__id")).join(table, "__id", "left")
    parts = F.sort_array(F.collect_list(F.struct("__pos", F.coalesce("__hex", F.lit("EFBFBD")).alias("h"))))
    text = F.make_valid_utf8(F.unhex(F.array_join(F.transform(parts, lambda x: x["h"]), "")).cast("string"))
    texts = places.groupBy("__row").agg(text.alias("decoded"))
    out = rows.join(texts, "__row", "left")
    decoded = F.when(col(ids_col).isNull(), F.lit(None)).otherwise(F.coalesce("decoded", F.lit("")))
    return out.select(*[col(c) for c in df.columns], decoded.alias("decoded"))


def encode_rows(df: DataFrame, vocabulary: str | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``encode`` without its exchange: ``doc_id`` and ``token_ids``, each text encoded by itself, by the tokenizer library.

    For operators that need ids but not each distinct pre-token's encoding in one place. Here ``token_ids`` is binary, the ids as
    little-endian 32-bit numbers, which is cheap to store and to read. Nulls and repeated rows as in ``encode``.
    """

    def packed(ids: list[list[int] | None]) -> pa.Array:
        return pa.array([None if x is None else np.array(x, dtype="<u4").tobytes() for x in ids], pa.binary())

    return _rows(df, vocabulary, text_col, id_col, "token_ids binary", packed)


def count_rows(df: DataFrame, vocabulary: str | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id`` and ``n_tokens`` (bigint) of ``encode``, without the ids."""
    return _rows(df, vocabulary, text_col, id_col, "n_tokens bigint", lambda ids: pa.array([None if x is None else len(x) for x in ids], pa.int64()))


def _rows(df: DataFrame, vocabulary: str | None, text_col: str, id_col: str, out: str, made: Callable[[list], pa.Array]) -> DataFrame:
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_text = text_encoder(path)
        for b in batches:
            for part in (b.slice(at, TEXTS) for at in range(0, b.num_rows, TEXTS)):
                texts = (t.as_py() for t in part.column(1))
                ids = (None if t is None else encode_text(t) for t in texts)
                yield pa.RecordBatch.from_arrays([part.column(0), made(list(ids))], ["doc_id", out.split()[0]])

    docs = tidy(df).select(col(id_col).cast("bigint").alias("doc_id"), col(text_col).alias("text"))
    return docs.mapInArrow(lean(run), "doc_id bigint, " + out)
