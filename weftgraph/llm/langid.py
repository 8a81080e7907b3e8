"""Language identification by rank-order n-gram profiles (out-of-place distance).

A text is lower-cased, every run of non-letters becomes one space, and its n-grams of 1 to 3
characters are counted over the whole text, each word padded with a space on either side. Its
``top`` most frequent n-grams, ties broken by code, are compared with each language's: the sum
over them of the difference in rank, or ``top`` where the profile lacks the n-gram. N-grams are
64-bit integers, sorted and counted by numpy; the corpus is read once and nothing is shuffled.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, stash, tidy

TOP = 300
#: Bound on the labelled documents a language's profile is fitted on, those of smallest md5 of the id.
TRAIN_DOCS = 400
#: The chosen ids, ``TRAIN_DOCS`` a language, are broadcast up to this number; beyond, documents are shuffled.
BROADCAST_IDS = 2_000_000
#: A document is rejected when its distance is over this share of the largest possible one.
MAX_DISTANCE = 0.65


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def ngram_codes(text: str) -> np.ndarray:
    """Codes of all n-grams of the text, with repeats: up to three code points, 21 bits each."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    c = np.where(_letters()[c], c, 32).astype(np.int64)
    c = np.concatenate(([32], c, [32]))
    c = c[~((c == 32) & np.concatenate(([False], c[:-1] == 32)))]
    if len(c) < 3:
        return np.empty(0, dtype=np.int64)
    two = c[:-1] << 21 | c[1:]
    three = (two[:-1] << 21 | c[2:])[c[1:-1] != 32]
    return np.concatenate((c[c != 32], two, three))


def top_ngrams(text: str, top: int = TOP) -> np.ndarray:
    """The most frequent n-grams, best first; ties by code, the smaller first."""
    codes, counts = np.unique(ngram_codes(text), return_counts=True)
    return codes[np.lexsort((codes, -counts))[:top]]


class Profiles:
    """Rank lookups for a fixed set of languages, in their order of name."""

    def __init__(self, ranked: dict[str, np.ndarray], top: int = TOP) -> None:
        self.langs, self.top = sorted(ranked), top
        self.codes = np.unique(np.concatenate([ranked[x] for x in self.langs])) if ranked else np.empty(0, np.int64)
        self.ranks = np.full((len(self.codes) + 1, len(self.langs)), -1, dtype=np.int64)
        for k, x in enumerate(self.langs):
            self.ranks[np.searchsorted(self.codes, ranked[x]), k] = np.arange(len(ranked[x]))

    def distances(self, grams: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.codes, grams)
        at[(at == len(self.codes)) | (self.codes[np.minimum(at, len(self.codes) - 1)] != grams)] = len(self.codes)
        ranks = self.ranks[at]
        return np.where(ranks < 0, self.top, np.abs(ranks - np.arange(len(grams))[:, None])).sum(axis=0)


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", train_docs: int = TRAIN_DOCS, top: int = TOP) -> Profiles:
    """Profiles from at most ``train_docs`` labelled documents a language.

    The documents are chosen from all labelled ones by the md5 of their id. Rows without id, text or
    language are not used. What comes back has ``top`` rows a language.
    """
    known = tidy(df).filter(col(text_col).isNotNull() & col(lang_col).isNotNull() & col(id_col).isNotNull())
    rank = Window.partitionBy("lang").orderBy(F.md5(F.col("id").cast("string")), "id")
    ids = known.select(col(id_col).alias("id"), col(lang_col).alias("lang"))
    picked = stash(ids.withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= train_docs).select("id").distinct(), "train-ids")
    if picked.count() <= BROADCAST_IDS:
        picked = F.broadcast(picked)
    sample = known.select(col(id_col).alias("id"), col(lang_col).alias("lang"), col(text_col).alias("text")).join(picked, "id", "left_semi")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, rows in b.groupby("lang"):
                codes, counts = np.unique(np.concatenate([ngram_codes(t) for t in rows["text"]]), return_counts=True)
                yield pd.DataFrame({"lang": lang, "code": codes, "n": counts})

    counts = sample.select("lang", "text").mapInPandas(count, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    rows = counts.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= top).orderBy("lang", "r").collect()
    ranked: dict[str, list[int]] = {}
    for r in rows:
        ranked.setdefault(r["lang"], []).append(r["code"])
    return Profiles({k: np.array(v, dtype=np.int64) for k, v in ranked.items()}, top)


def identify(df: DataFrame, profiles: Profiles, text_col: str = "text", max_distance: float = MAX_DISTANCE) -> DataFrame:
    """All rows with ``pred_lang``, ``distance``, ``n_grams`` and ``accepted``.

    ``distance`` is the smallest out-of-place sum; among equal ones the first language by name wins.
    A text without letters, or null, has ``pred_lang`` null, ``distance`` null, ``n_grams`` 0 and is not
    accepted, and so is any text when there are no profiles. A row is accepted when ``distance`` is at
    most ``max_distance * top * n_grams``. Repeated rows are judged alike.
    """
    df = tidy(df, ("pred_lang", "distance", "n_grams", "accepted", "__id"), keep=(text_col,))
    names = df.columns

    @F.pandas_udf("pred_lang string, distance bigint, n_grams int")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for t in texts:
                grams = top_ngrams(t, profiles.top) if t else ()
                if len(grams) and profiles.langs:
                    d = profiles.distances(grams)
                    out.append((profiles.langs[int(d.argmin())], int(d.min()), len(grams)))
                else:
                    out.append((None, None, 0))
            out = pd.DataFrame(out, columns=["pred_lang", "distance", "n_grams"])
            yield out.assign(distance=out["distance"].astype("Int64"))

    out = df.withColumn("__id", judge(col(text_col))).select(*[col(c) for c in names], "__id.*")
    ok = F.col("distance") <= F.lit(max_distance * profiles.top) * F.col("n_grams")
    return out.withColumn("accepted", F.coalesce(ok, F.lit(False)))


def oracle(train_docs: int = TRAIN_DOCS, top: int = TOP, max_distance: float = MAX_DISTANCE) -> str:
    """DuckDB SQL for ``fit`` and ``identify`` on documents: the accepted rows."""
    return rf"""
WITH norm AS (SELECT doc_id, lang, ' ' || trim(regexp_replace(lower(text), '[^\p{{L}}]+', ' ', 'g')) || ' ' AS t FROM documents WHERE text IS NOT NULL),
chars AS (SELECT doc_id, lang, unnest(string_split(t, '')) AS a, generate_subscripts(string_split(t, ''), 1) AS i FROM norm WHERE t <> '  '),
wide AS (SELECT doc_id, lang, a, lead(a, 1) OVER w AS b, lead(a, 2) OVER w AS c FROM chars WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
coded AS (SELECT doc_id, lang, CAST(ascii(a) AS BIGINT) AS k FROM wide WHERE a <> ' '
  UNION ALL SELECT doc_id, lang, ascii(a) * CAST({1 << 21} AS BIGINT) + ascii(b) FROM wide WHERE b IS NOT NULL
  UNION ALL SELECT doc_id, lang, ascii(a) * CAST({1 << 42} AS BIGINT) + ascii(b) * CAST({1 << 21} AS BIGINT) + ascii(c) FROM wide WHERE c IS NOT NULL AND b <> ' '),
counts AS (SELECT doc_id, lang, k, count(*) AS c FROM coded GROUP BY ALL),
train AS (SELECT doc_id FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) <= {train_docs}),
prof AS (SELECT lang AS plang, k, row_number() OVER (PARTITION BY lang ORDER BY sum(c) DESC, k) - 1 AS pr FROM counts WHERE doc_id IN (SELECT doc_id FROM train) GROUP BY lang, k QUALIFY pr < {top}),
doc AS (SELECT doc_id, k, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, k) - 1 AS dr FROM counts QUALIFY dr < {top}),
dist AS (SELECT d.doc_id, l.plang, sum(CASE WHEN p.pr IS NULL THEN {top} ELSE abs(p.pr - d.dr) END) AS distance, count(*) AS n
  FROM doc d CROSS JOIN (SELECT DISTINCT plang FROM prof) l LEFT JOIN prof p ON p.plang = l.plang AND p.k = d.k GROUP BY ALL),
best AS (SELECT * FROM dist QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY distance, plang) = 1)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, plang AS pred_lang, CAST(distance AS BIGINT) AS distance, CAST(n AS INTEGER) AS n_grams
FROM best JOIN documents d USING (doc_id) WHERE distance <= {max_distance * top} * n"""


def accepted(df: DataFrame) -> DataFrame:
    """The accepted documents with their language, by profiles fitted on the same table."""
    return identify(df, fit(df)).filter("accepted").drop("accepted")
