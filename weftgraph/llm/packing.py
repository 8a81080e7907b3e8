"""Best-fit packing of documents into fixed-size sequences by hierarchical residual packing.

Round 0 hashes the pieces into groups of bounded size and packs every group by best fit,
longest first. Bins that are nearly full are final; the underfull ones become items, and
``fan_in`` groups merge into one for the next round. A bin is final, too, as soon as nothing that is left fits into it, and
no round puts more than ``group_items`` bins on average into a group: when groups can no longer be merged within that, the bins
stand as they are. Only (doc_id, piece, size) triples move, never texts.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, stash, tidy

_BINS = "rnd int, grp bigint, k bigint, done boolean, used bigint, doc_ids array<bigint>, pieces array<int>, sizes array<bigint>"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices of the items in each bin; items are taken in the given order.

    Each goes to the bin with the least room that still holds it, the oldest such bin first.
    """
    bins: list[list[int]] = []
    rooms: list[tuple[int, int]] = []  # (room, bin), sorted
    for i, s in enumerate(sizes):
        at = bisect_left(rooms, (s, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        if room > s:
            insort(rooms, (room - s, b))
    return bins


def pack(
    df: DataFrame,
    capacity: int,
    size: str = "octet_length(text) + 1",
    id_col: str = "doc_id",
    near_full: float = 0.98,
    fan_in: int = 8,
    group_items: int = 20000,
) -> DataFrame:
    """One row a bin: ``bin_id``, ``used``, ``n_items``, ``doc_ids``, ``pieces``, ``sizes``.

    ``size`` is an SQL expression, by default the byte-level tokens of the text with one
    separator. An item longer than ``capacity`` is cut into pieces ``0, 1, ...``, all but the last
    of them full. A null size counts as 1 and one below 1 as 1, so that a document without text
    still appears once. Null ids and repeated rows are items like any other, hashed into groups by their places in the
    table. Ids are integers, or strings of integers; any other string is an error. Ties are taken by (size descending, id, piece). An empty table gives no bins. Other columns are not read.
    """
    if capacity < 1 or fan_in < 2 or group_items < 1:
        raise ValueError("capacity and group_items must be positive, fan_in at least 2")
    items = tidy(df).select(
        col(id_col).cast("bigint").alias("doc_id"),
        F.greatest(F.coalesce(F.expr(size).cast("bigint"), F.lit(1)), F.lit(1)).alias("size"),
    )
    items = stash(items, "pack-items")
    rows = items.count()
    groups = max(1, -(-rows // group_items))
    last = F.floor((F.col("size") - 1) / F.lit(capacity)).cast("int")
    # copies of one row, however many, go to different groups
    placed = items.withColumn("grp", F.pmod(F.xxhash64("doc_id", "size", F.monotonically_increasing_id()), F.lit(groups)))
    pieces = placed.select("doc_id", F.explode(F.sequence(F.lit(0), last)).alias("piece"), "size", "grp").select(
        "grp",
        F.least(F.col("size") - F.col("piece") * F.lit(capacity).cast("bigint"), F.lit(capacity).cast("bigint")).alias("used"),
        F.array("doc_id").alias("doc_ids"),
        F.array("piece").alias("pieces"),
    )
    now = pieces.withColumn("sizes", F.array("used"))
    full = now.filter(F.col("used") == capacity).select(
        F.lit(-1).alias("rnd"), F.lit(0).cast("bigint").alias("grp"), F.monotonically_increasing_id().alias("k"), F.lit(True).alias("done"), "used", "doc_ids", "pieces", "sizes"
    )
    now = now.filter(F.col("used") < capacity)
    done: list[DataFrame] = [full]
    rnd, left = 0, groups
    while True:
        out = stash(now.groupBy("grp").applyInPandas(_packer(rnd, capacity, near_full), _BINS), f"pack-{rnd}")
        open_ = out.filter("not done")
        least = open_.agg(F.min("used")).first()[0] if left > 1 else None
        takes = F.lit(False) if least is None else ~F.col("done") & (F.col("used") + F.lit(least) <= capacity)
        n = 0 if least is None else out.filter(takes).count()
        merged = max(-(-left // fan_in), -(-n // group_items))
        if not n or merged >= left:
            done.append(out)
            break
        done.append(out.filter(~takes))
        now = out.filter(takes).select(F.floor(F.col("grp") * merged / left).cast("bigint").alias("grp"), "used", "doc_ids", "pieces", "sizes")
        rnd, left = rnd + 1, merged
    bins = done[0]
    for d in done[1:]:
        bins = bins.unionByName(d)
    return bins.select(
        F.format_string("%d-%d-%d", "rnd", "grp", "k").alias("bin_id"), "used", F.size("doc_ids").alias("n_items"), "doc_ids", "pieces", "sizes"
    )


def _packer(rnd: int, capacity: int, near_full: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [
            (-int(u), [(d is None, d or 0) for d in ds], list(ps), list(ds), list(zs))
            for u, ds, ps, zs in zip(pdf["used"], map(_ints, pdf["doc_ids"]), map(_ints, pdf["pieces"]), map(_ints, pdf["sizes"]))
        ]
        rows.sort(key=lambda r: r[:3])
        out = []
        for k, members in enumerate(best_fit([-r[0] for r in rows], capacity)):
            used = sum(-rows[i][0] for i in members)
            out.append((
                rnd, int(pdf["grp"].iloc[0]), k, used >= near_full * capacity, used,
                [d for i in members for d in rows[i][3]], [p for i in members for p in rows[i][2]], [z for i in members for z in rows[i][4]],
            ))
        return pd.DataFrame(out, columns=["rnd", "grp", "k", "done", "used", "doc_ids", "pieces", "sizes"])

    return run


def _ints(values) -> list[int | None]:
    return [None if v is None or v != v else int(v) for v in values]
