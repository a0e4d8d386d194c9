"""A training-data pipeline over documents: toxicity, near copies, benchmark leaks, source mix, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verdigris.llm._shared import materialize, table
from verdigris.llm.decontam import drop_leaks
from verdigris.llm.mixture import mixed_documents
from verdigris.llm.ngram_join import keep_one_per_component
from verdigris.llm.sharding import assign_shards
from verdigris.llm.toxicity import drop_toxic, fit_classifier


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, fit_classifier(docs, table(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_per_component(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return assign_shards(docs, carry=True)


STAGES = [("toxicity", toxicity), ("ngram_join", near_copies), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: A trained classifier decides the first stage, so SQL can't express the rows; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
