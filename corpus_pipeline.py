"""A training corpus in five stages, each over all that the stage before it kept.

Rejected documents go (quality), one document of each group of near duplicates stays, documents that leak a benchmark item
go, personal data is replaced by its kind, and what is left is packed into sequences. ``documents`` keeps its columns up
to the last stage, whose rows are the placed pieces with their ids. Empty tables, nulls and other columns are handled as
the operators' modules say.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from colloquy.functions.materialize import dropped, scoped, settled
from colloquy.llm import decontaminate, packing, pii, quality, simhash_near

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: By stage the folders of the tables that it has written for itself.
_left: dict[Stage, list[str]] = {}


def stage(function: Stage) -> Stage:
    """A stage that first deletes what the one before it has written for itself, unless ``docs`` is still computed from that: a
    stage's documents are its predecessor's rows as written and read again."""

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        order = [one for _, one in STAGES]
        before = order[order.index(run_stage) - 1] if order.index(run_stage) else None
        if folders := _left.pop(before, []):
            read = docs.inputFiles()
            used = [folder for folder in folders if any(folder.rsplit("/", 1)[1] in file for file in read)]
            for folder in set(folders) - set(used):
                dropped(spark, folder)
            _left[before] = used
        rows, folder = scoped(lambda: function(spark, docs, sf_dir), spark)
        _left.setdefault(run_stage, []).append(folder)
        return rows

    return run_stage


@stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble does not reject."""
    return quality.filtered(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@stage
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return simhash_near.deduplicated(docs)


@stage
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced."""
    return pii.redacted(docs)


@stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their places in sequences."""
    return packing.packed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Models and tokens are not to be said in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written and read again in the shared folder, and what a stage has written
    for itself goes when they are, its predecessor's rows too."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, one in STAGES[:-1]:
        docs, path = settled(lambda docs=docs, one=one: one(spark, docs, sf_dir), spark, f"stage-{name}")
        if before:
            dropped(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
