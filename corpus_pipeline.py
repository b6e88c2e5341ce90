"""The training-data pipeline: five stages, each applying one operator.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; its rows
are written as Parquet and read again as the next stage's ``docs``. All but
the last return the columns of ``documents``.

1. ``quality``: documents that the nearest-neighbour classifier scores below
   0.3 go.
2. ``near_dedup``: one document of each near-duplicate component stays (the
   least doc_id), on five-word shingles at similarity 0.8.
3. ``decontaminate``: benchmark passages are cut out; a document that is
   mostly benchmark goes.
4. ``secrets``: secret spans are replaced by a mark.
5. ``mixing``: documents are repeated and dealt into output shards by source
   weights; one row per copy, with shard, copy and the shuffling key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargoscope.llm import decontaminate, mixing, near_dup, quality_knn, secrets
from cargoscope.llm.common import crc_mod, free_name, staged, tables

QUALITY_FROM = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that score ``QUALITY_FROM`` or more. The labels of
    one id in five (crc32 of the id modulo 5 is 0) are left for evaluation."""
    model = quality_knn.fit(docs, tables(spark, sf_dir, "labels"), use=crc_mod("doc_id", 5) != 0)
    score = free_name(docs, "score")
    return quality_knn.score(docs, model, out=score).filter(
        F.col(score) >= QUALITY_FROM).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component."""
    return near_dup.deduplicate(docs, shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages; drops documents that are mostly such passages."""
    return decontaminate.decontaminate(docs, tables(spark, sf_dir, "benchmark"), window=10)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents by source weight and deals the copies into shards."""
    mixed = mixing.mix(docs).drop("size", "source_size", "target", "copies")
    return mixing.shuffled(mixed)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontamination),
    ("secrets", secret_scan),
    ("mixing", mix),
]

ORACLE_SQL = None  # sketches, learnt votes and seeded draws are beyond SQL; see tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = tables(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
