"""The corpus pipeline: STAGES applied to documents in order, each one's result written and read again.

quality_rules keeps the documents that the base rule and the adaptive thresholds accept; near_duplicates keeps one
document of each group of linked fingerprints; decontamination drops documents that leak a benchmark item;
personal_data replaces spans in texts by their kind; mixing keeps the documents that the mix takes, with how often
(mix_copies) and when (mix_time), in the order of mix_time.  The first four return the columns of documents.

A stage is called with its predecessor's result written and read again, so it begins by deleting the tables that its
predecessor staged for itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from oxbow.llm import decontaminate, mix, pii, quality, simhash
from oxbow.llm._common import drop_staged, read, stage, staged_here

Step = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix.mixed(docs)


_made: list = []


def _tidy(step: Step, first: bool) -> Step:
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not first:
            drop_staged(_made)
        with staged_here() as made:
            out = step(spark, docs, sf_dir)
        _made[:] = made
        return out

    return run_step


STAGES = [(step.__name__, _tidy(step, k == 0)) for k, step in enumerate([quality_rules, near_duplicates, decontamination, personal_data, mixing])]
#: SimHash and the skip-chain field have no SQL: tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        docs = docs if k == len(STAGES) - 1 else stage(docs, name)
    return docs
