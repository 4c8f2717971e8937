"""A corpus from raw documents: the stages, each over all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next one's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import mixing, packing, quality, shinglesets, substring
from factloom.llm.shared import listed, remove, shared_dir

#: Paths of scratch tables: each run has a list of its own, stages that are called singly share one.
_scratch: ContextVar[list[str]] = ContextVar("scratch of a run", default=[])  # noqa: B039


def _stage(f: Callable) -> Callable:
    """A stage that first removes the scratch tables of the stage before it, whose result has been written by then."""

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        remove(spark, _scratch.get())
        with listed(_scratch.get()):
            return f(spark, docs, sf_dir)

    return run



@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that weak supervision keeps."""
    return quality.good_documents(docs)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more): the one with the smallest id."""
    return shinglesets.one_of_each(docs)


@_stage
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that occur earlier; texts that lose nothing stay as they are."""
    return substring.without_repeats(docs)


@_stage
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


@_stage
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their bins."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("source mix", source_mix),
    ("best-fit packing", best_fit_packing),
]

#: Expectation-maximisation, components and packing aren't SQL; tests/llm compares whole runs with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in ``sf_dir``."""
    before = _scratch.set([])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/factloom/pipeline-{uuid.uuid4().hex}"
    try:
        for i, (_, stage) in enumerate(STAGES):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
            docs = spark.read.parquet(f"{folder}/{i}")
    finally:
        remove(spark, _scratch.get())
        _scratch.reset(before)
    return docs
