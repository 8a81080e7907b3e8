"""Runs a registered query and its SQL over the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return bytes(v) if isinstance(v, bytearray) else v


def rows_of(names, rows):
    order = [names.index(c) for c in sorted(names)]
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def same(spark, query, sql: str, sf_dir: str) -> bool:
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*' if p.is_dir() else ''}')")
    df = query(spark, sf_dir)
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return sorted(names) == sorted(df.columns) and rows_of(names, got.fetchall()) == rows_of(df.columns, df.collect())
