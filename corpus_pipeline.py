"""The corpus pipeline: stages that each read what the one before has written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pointloom.llm import decontam, jaccard, packing, quality
from pointloom.llm.frames import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the model is fitted on this stage's own input.

    As in the stages behind, other columns pass through under any name.  Null, empty and short
    texts go; rows without a doc_id and repeated rows are judged each by itself; whole texts are
    read; an empty table gives an empty result.
    """
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that the n-gram Jaccard join links: the least doc_id.

    Of equal rows one stays; rows of one doc_id with texts that are not alike stay apart; rows
    without a doc_id stay; whole texts count; an empty table gives an empty result.
    """
    return jaccard.keep_one(docs, jaccard.join(docs, hashes=True))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark, with or without an id.

    Null and empty texts and rows without a doc_id stay, as they hold none; repeated rows are
    judged each by itself; whole texts are searched; without items all stay.
    """
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each a sequence of its own, with checksums of their ids.

    Null and empty texts are the end token alone; repeated rows are packed each by itself; a
    null doc_id stays null; whole texts are packed; an empty table gives an empty result.
    """
    return packing.digest(packing.pack(docs))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: Hashing, minimum hashes and a tokenizer have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's output is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
