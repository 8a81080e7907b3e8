"""A corpus pipeline: quality rules, language ID, near-duplicate removal and packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's ``docs``. All but the last return the columns of ``documents``. Documents whose
text is null, empty or blank go in the first stage; null ids are never near duplicates; repeated rows are judged alike; an
empty table gives no bins; columns beyond those of ``documents`` are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import bpe, jaccard, langid, packing, quality
from weftgraph.llm.common import col, read, stash
from weftgraph.llm.queries import CAPACITY
from weftgraph.session import ship


def _as(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The input columns of ``out``, which come first, under their names in ``docs``, whatever outputs these clash with."""
    return out.select(*[col(c) for c in out.columns[: len(docs.columns)]]).toDF(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line rules accept, with their cleaned text; the rest go."""
    return _as(quality.accepted(docs), docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; the rest go."""
    return _as(langid.accepted(docs), docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that similar n-gram sets link, that of smallest id; the rest go."""
    return jaccard.keep_one(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bins of all documents kept so far, by their numbers of byte-level BPE tokens, each with one separator."""
    return packing.pack(bpe.count_rows(docs), CAPACITY, "n_tokens + 1")


STAGES = [
    ("quality rules", quality_stage),
    ("language ID", language_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("best-fit packing", packing_stage),
]

#: Near-duplicate components and packing cannot be expressed; tests hold the run against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = read(ship(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
