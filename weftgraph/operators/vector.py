"""Vector search with exact cosine distance, and the search that joins its hits to the graph."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import scalar
from ..graph import CodeGraph
from ..session import ship
from ..storage import small, spread, stash

DIMENSIONS = 256
#: Vectors in a block of the blocked search: 4096 of 256 doubles are 8 MB.
BLOCK = 4096
#: Rows of a block that are compared at a time: 256 by 4096 distances are 8 MB.
SLICE = 256


_CAMEL, _WORD = r"([a-z0-9])([A-Z])", r"[a-z0-9]+"


def embed(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """A deterministic embedding: words and their parts hashed into signed buckets, of length 1; zeros for a text without words."""
    camel, word, crc = re.compile(_CAMEL), re.compile(_WORD), zlib.crc32

    @F.arrow_udf("array<float>")
    def vectors(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            out = np.zeros((len(batch), dimensions))
            for row, t in zip(out, batch.to_pylist()):
                hashes = np.array([crc(w.encode()) for w in word.findall(camel.sub(r"\1 \2", t or "").lower())], dtype=np.int64)
                np.add.at(row, hashes % dimensions, 1.0 - 2.0 * (hashes >> 16 & 1))
            norm = np.linalg.norm(out, axis=1, keepdims=True)
            out = (out / np.where(norm > 0, norm, 1.0)).astype(np.float32)
            yield pa.ListArray.from_arrays(np.arange(0, out.size + 1, dimensions, dtype=np.int32), pa.array(out.ravel()))

    return vectors(text)


def document_table(nodes: DataFrame) -> DataFrame:
    """``node_id`` and ``document`` of all symbols, files and externals left out."""
    some = nodes.filter(~F.col("kind").isin(S.FILE, S.EXTERNAL))
    return some.select("node_id", scalar.document_string(F.col("name"), F.col("signature"), F.col("docstring")).alias("document"))


def upsert_vectors(vectors: DataFrame, nodes: DataFrame, embedder: Callable[[Column], Column] = embed) -> DataFrame:
    """``vectors`` with new ones for new or changed documents, and without those of ids that ``nodes`` lacks.

    Only documents that differ from the stored ones are embedded.
    """
    docs = document_table(nodes)
    same = vectors.join(docs, ["node_id", "document"], "left_semi").select(*S.VECTOR_SCHEMA.fieldNames())
    new = docs.join(same.select("node_id"), "node_id", "left_anti").withColumn("embedding", embedder(F.col("document")))
    return same.unionByName(new.select(*S.VECTOR_SCHEMA.fieldNames()))


def delete_file(vectors: DataFrame, file: str) -> DataFrame:
    return vectors.filter(~F.col("node_id").startswith(file + "::"))


def cosine(a: Column, b: Column) -> Column:
    """1 less the cosine, from 0 to 2; 1 where a vector has no length, null where lengths differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norms > 0, 1 - dot(a, b) / norms).when(F.size(a) == F.size(b), 1.0)


def top_k(vectors: DataFrame, query: list[float] | Column, k: int) -> DataFrame:
    """The ``k`` vectors nearest to one query, by distance, then id: one scan, and ``k`` rows a task to the driver."""
    q = query if isinstance(query, Column) else F.array(*[F.lit(float(x)) for x in query])
    near = vectors.select("node_id", "document", F.round(cosine(F.col("embedding"), q), 6).alias("distance")).filter("distance IS NOT NULL")
    return near.orderBy("distance", "node_id").limit(k)


_BLOCKED = "query_id string, node_id string, distance double"


def top_k_all(vectors: DataFrame, queries: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """``query_id``, ``node_id``, ``distance``, ``rank`` (from 1) of the ``k`` nearest vectors of every query, exactly.

    ``queries`` has (query_id, embedding). Both sides are cut into blocks of ``block`` rows; a task multiplies two blocks
    and keeps ``k`` for each query, so that memory does not grow with the tables. Distances are rounded to
    6 places, ties are taken by id. Null vectors and those whose length is not the query's have no distance.
    """
    ship(vectors.sparkSession)
    # a Cartesian product has a task for each pair of partitions; an equi-join on the length would meet in one
    pairs = stash(_blocks(queries, "query_id", "q", block), "blocks-q").crossJoin(stash(_blocks(vectors, "node_id", "v", block), "blocks-v"))
    return _nearest(pairs, k)


def _blocks(df: DataFrame, key: str, side: str, block: int, centres: np.ndarray | None = None, probes: int = 0) -> DataFrame:
    """Runs of up to ``block`` vectors of one length as rows.

    With ``centres``, in order of cell: queries with the bits of their ``probes`` nearest cells, others with their ``cell``.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for n, rows in b.groupby(b["e"].map(len)):
                for at in range(0, len(rows), block):
                    part = rows.iloc[at : at + block]
                    x = np.stack(part["e"].to_numpy()).astype("<f8")
                    more = {}
                    if probes:
                        bits, near = np.zeros((len(x), len(centres)), np.uint8), _nearest_centres(x, centres, probes)
                        np.put_along_axis(bits, near, 1, axis=1)
                        order = np.argsort(near[:, 0], kind="stable")  # neighbours probe like cells
                        x, part, more = x[order], part.iloc[order], {"probes_q": [np.packbits(bits[order], axis=1).tobytes()]}
                    elif centres is not None:
                        more = {"cells_v": [part["cell"].to_numpy().astype("<i4").tobytes()]}
                    yield pd.DataFrame({f"ids_{side}": [part["id"].tolist()], f"n_{side}": [int(n)], f"data_{side}": [x.tobytes()], **more})

    celled = centres is not None and not probes
    rows = df.filter(F.col(key).isNotNull() & F.col("embedding").isNotNull()).select(F.col(key).cast("string").alias("id"), F.col("embedding").alias("e"), *["cell"] * celled)
    more = ", probes_q binary" if probes else ", cells_v binary" if celled else ""
    return rows.mapInPandas(pack, f"ids_{side} array<string>, n_{side} int, data_{side} binary{more}")


def _nearest(pairs: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each query from pairs of blocks; where these have cells, among the vectors in the cells that a query probes."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i] for c in b.schema.names}
                n = row["n_q"].as_py()
                if n != row["n_v"].as_py():
                    continue
                q, v = (np.frombuffer(row[f"data_{x}"].as_buffer(), "<f8").reshape(-1, n) for x in "qv")
                ids_q, ids = (np.array(row[f"ids_{x}"].as_py(), dtype=object) for x in "qv")
                order = np.argsort(ids, kind="stable")
                v, ids = v[order], ids[order]
                cells = np.frombuffer(row["cells_v"].as_buffer(), "<i4")[order] if "cells_v" in row else None
                probes = np.unpackbits(np.frombuffer(row["probes_q"].as_buffer(), np.uint8).reshape(len(q), -1), axis=1).astype(bool) if "probes_q" in row else None
                for at in range(0, len(q), SLICE):
                    some = slice(at, at + SLICE)
                    use = np.arange(len(v)) if probes is None else np.flatnonzero(probes[some].any(axis=0)[cells])
                    norms = np.linalg.norm(q[some], axis=1)[:, None] * np.linalg.norm(v[use], axis=1)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        d = np.round(np.where(norms > 0, 1 - q[some] @ v[use].T / norms, 1.0), 6) + 0.0
                    if probes is not None:
                        d[~probes[some][:, cells[use]]] = np.inf
                    best = np.argsort(d, axis=1, kind="stable")[:, :k]
                    near = np.take_along_axis(d, best, axis=1).ravel()
                    held = near != np.inf
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids_q[some], best.shape[1])[held], pa.string()), pa.array(ids[use][best].ravel()[held], pa.string()), pa.array(near[held])], names=["query_id", "node_id", "distance"])

    found = pairs.mapInArrow(multiply, _BLOCKED)
    rank = Window.partitionBy("query_id").orderBy("distance", "node_id")
    return found.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)


#: Vectors that the cells of an index are fitted on, and cells of an index at most.
SAMPLE, CELLS = 20_000, 1024


@dataclass(frozen=True)
class CellIndex:
    """An approximate index: every vector in the cell of the centre that is nearest by cosine.

    The centres are fitted on at most ``SAMPLE`` vectors, chosen by the hash of their ids; all vectors are indexed. A search reads the
    ``probes`` cells nearest to each query, exactly within them, so that it misses a vector only if its cell is not among these. Their
    number is fitted as well: so many that ``recall`` of the nearest neighbours within the sample are found. Where vectors have no clusters, that may
    be most cells. All vectors have one length; others, and null ones, are left out.
    """

    cells: DataFrame  # node_id, embedding, cell
    centres: np.ndarray
    probes: int

    @classmethod
    def fit(cls, vectors: DataFrame, n_cells: int | None = None, sample: int = SAMPLE, rounds: int = 10, recall: float = 0.97) -> CellIndex:
        """``n_cells`` is by default about the root of the number of vectors, at most CELLS."""
        ship(vectors.sparkSession)
        some = vectors.filter("node_id IS NOT NULL AND embedding IS NOT NULL")
        held = [r[0] for r in some.select("embedding", F.xxhash64("node_id").alias("h"), "node_id").orderBy("h", "node_id").limit(sample).collect()]
        width = max((len(e) for e in held), default=0)
        x = _unit_rows(np.array([e for e in held if len(e) == width], dtype=np.float64).reshape(-1, max(1, width)))
        n = min(n_cells or min(CELLS, math.isqrt(some.count())), len(x)) or 1
        centres = x[np.linspace(0, len(x) - 1, n).astype(int)] if len(x) else np.zeros((1, 1))
        for _ in range(rounds if len(x) else 0):
            near = np.argmax(x @ centres.T, axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, x)
            filled = np.bincount(near, minlength=n) > 0
            centres = np.where(filled[:, None], _unit_rows(sums), centres)
        ask = x[np.linspace(0, len(x) - 1, min(200, len(x))).astype(int)] if len(x) else x
        truth = np.argsort(-(ask @ x.T), axis=1, kind="stable")[:, :20]
        place = np.argsort(np.argsort(-(ask @ centres.T), axis=1, kind="stable"), axis=1)
        found = np.sort(np.take_along_axis(place, np.argmax(x @ centres.T, axis=1)[truth], axis=1).ravel()) if len(x) else np.zeros(1, int)
        probes = int(found[min(len(found) - 1, int(recall * len(found)))]) + 1
        whole = some.filter(F.size("embedding") == width).select(F.col("node_id").cast("string").alias("node_id"), "embedding")
        # a cell of many vectors is in several partitions
        placed = _in_cells(whole, "node_id", centres).repartition("cell", F.pmod(F.xxhash64("node_id"), F.lit(8))).sortWithinPartitions("cell")
        return cls(stash(placed, "cells"), centres, probes)

    def top_k(self, queries: DataFrame, k: int, probes: int | None = None, block: int = BLOCK) -> DataFrame:
        """``top_k_all`` over the cells nearest to each query; fewer than ``k`` where these hold fewer.

        A query is not copied for each of its cells: blocks of queries, with the cells they probe, meet blocks of vectors in order of cell.
        """
        some = queries.filter("query_id IS NOT NULL AND embedding IS NOT NULL").filter(F.size("embedding") == self.centres.shape[1])
        asked = _blocks(some, "query_id", "q", block, self.centres, min(probes or self.probes, len(self.centres)))
        return _nearest(stash(asked, "blocks-q").crossJoin(stash(_blocks(self.cells, "node_id", "v", block, self.centres), "blocks-v")), k)


def _unit_rows(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1.0)


def _nearest_centres(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centres of each row, in order, SLICE rows at a time."""
    parts = [np.argsort(-(x[at : at + SLICE] @ centres.T), axis=1, kind="stable")[:, :n].astype(np.int32) for at in range(0, len(x), SLICE)]
    return np.concatenate(parts) if parts else np.zeros((0, n), np.int32)


def _in_cells(df: DataFrame, key: str, centres: np.ndarray) -> DataFrame:
    """Each row with its nearest centre as ``cell``."""

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(cell=_nearest_centres(np.stack(b["embedding"].to_numpy()).astype(np.float64), centres, 1)[:, 0])

    return df.mapInPandas(near, f"{key} string, embedding array<float>, cell int")


def hits(graph: CodeGraph, found: DataFrame) -> DataFrame:
    """The hits that are nodes, once each: ``query_id``, ``node_id``, ``distance``, ``pos`` from 1."""
    known = found.join(graph.nodes.select("node_id"), "node_id", "left_semi").groupBy("query_id", "node_id").agg(F.min("distance").alias("distance"))
    return known.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "node_id")))


def expand(graph: CodeGraph, direct: DataFrame, seeds: int = 3) -> DataFrame:
    """``query_id``, ``node_id``: callers and callees of each query's first ``seeds`` hits that are not hits themselves."""
    top = small(stash(direct.filter(F.col("pos") <= seeds).select("query_id", F.col("node_id").alias("hit")), "seeds"))
    calls = graph.edges.filter(F.col("kind") == S.CALLS).select("src", "tgt")
    ends = calls.select(F.col("tgt").alias("hit"), F.col("src").alias("node_id")).unionByName(calls.select(F.col("src").alias("hit"), F.col("tgt").alias("node_id")))
    near = stash(ends.join(top, "hit").select("query_id", "node_id").distinct(), "near")
    known = graph.nodes.select("node_id").join(small(near.select("node_id").distinct()), "node_id", "left_semi")
    return near.join(known, "node_id", "left_semi").join(direct.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti")


def context(graph: CodeGraph, rows: DataFrame) -> DataFrame:
    """``rows`` with sorted arrays ``callers`` and ``callees`` of their ``node_id``."""
    ids = small(stash(rows.select("node_id").distinct(), "ids"))
    known = graph.nodes.select("node_id")
    calls = graph.edges.filter(F.col("kind") == S.CALLS).select("src", "tgt")
    n = calls.count()

    def side(here: str, there: str, name: str) -> DataFrame:
        near = calls.join(ids.withColumnRenamed("node_id", here), here, "left_semi")
        near = spread(near, n, there).distinct().join(known.withColumnRenamed("node_id", there), there, "left_semi")
        return near.groupBy(F.col(here).alias("node_id")).agg(F.array_sort(F.collect_list(there)).alias(name))

    out = rows.join(side("tgt", "src", "callers"), "node_id", "left").join(side("src", "tgt", "callees"), "node_id", "left")
    none = F.array().cast("array<string>")
    return out.withColumn("callers", F.coalesce("callers", none)).withColumn("callees", F.coalesce("callees", none))


def search(graph: CodeGraph, vectors: DataFrame, queries: DataFrame, limit: int = 10, seeds: int = 3, expand_slots: int = 0) -> DataFrame:
    """``limit`` rows for each query: hits by distance, then nodes one call from the first ``seeds`` hits at distance 1.

    Every query (query_id, embedding) takes its ``max(limit, 20)`` nearest vectors. ``expand_slots`` of the rows are kept
    for expansions, where there are any; by default they come only where hits are too few.
    """
    direct = hits(graph, top_k_all(vectors, queries, max(limit, 20)))
    direct = stash(direct.select("query_id", "node_id", "distance", "pos"), "hits")
    found = direct.select("query_id", "node_id", "distance", F.lit(False).alias("is_expansion"))
    more = expand(graph, direct, seeds).select("query_id", "node_id", F.lit(1.0).alias("distance"), F.lit(True).alias("is_expansion"))
    if expand_slots:
        n = more.groupBy("query_id").agg(F.least(F.count(F.lit(1)), F.lit(expand_slots)).alias("held"))
        kept = direct.join(n, "query_id", "left").filter(F.col("pos") <= limit - F.coalesce("held", F.lit(0)))
        found = kept.select("query_id", "node_id", "distance", F.lit(False).alias("is_expansion"))
    order = Window.partitionBy("query_id").orderBy("is_expansion", "distance", "node_id")
    top = found.unionByName(more).withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= limit)
    return context(graph, stash(top, "found"))


SYSTEM_PROMPT = (
    "You explain source code. From the question and the symbols listed, tell shortly and precisely what they have to do "
    "with each other, naming files and lines."
)


def prompt_rows(graph: CodeGraph, found: DataFrame, most: int = 5) -> DataFrame:
    """``query_id``, ``n``, ``line``: a prompt line for each of the first ``most`` direct hits."""
    first = found.filter(~F.col("is_expansion")).withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))).filter(F.col("n") <= most)
    known = first.select("query_id", "n", "node_id").join(graph.nodes, "node_id")
    part = lambda label, c: F.when(F.col(c) != "", F.concat(F.lit(f"\n  {label}: "), F.col(c))).otherwise("")
    where = F.when(F.col("line") != 0, F.concat_ws(":", "file", F.col("line").cast("string"))).otherwise(F.col("file"))
    line = F.concat(F.col("n").cast("string"), F.lit(". "), "kind", F.lit(" "), "name", F.lit(" ("), where, F.lit(")"), part("signature", "signature"), part("doc", "docstring"))
    return known.select("query_id", "n", line.alias("line"))


def explain(graph: CodeGraph, found: DataFrame, question: str, model: Callable[[str, str], str] | None = None) -> str:
    """What ``model(system, prompt)`` says of the first hits; without a model a remark."""
    lines = [r["line"] for r in prompt_rows(graph, found).orderBy("n").collect()]
    if model is None:
        return "No language model is set; pass one to explain the hits."
    listed = "\n".join(lines) if lines else "(no symbol fits)"
    return model(SYSTEM_PROMPT, f"Question: {question}\n\nSymbols:\n{listed}")
