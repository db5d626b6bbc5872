"""From raw documents to packed training bins, one operator a stage.

Each stage is called when the rows of the one before have been written; what that one left behind is deleted first,
so the disk holds the tables of one stage only.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from stormglass.llm import decontaminate, jaccard, packing, pii, quality
from stormglass.storage import materialise, release, tables_of

NEAR_WORDS, NEAR_PERCENT = 5, 80
OWNER = "pipeline"


def stage(work):
    """A stage that first deletes what earlier ones left, except what `docs` reads."""
    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, OWNER, docs)
        with tables_of(OWNER):
            return work(spark, docs, sf_dir)
    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that too many documents share."""
    return quality.apply(docs)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 on five-word shingles."""
    return jaccard.apply(docs, size=NEAR_WORDS, percent=NEAR_PERCENT)


@stage
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too little of any benchmark item to count as contaminated."""
    return decontaminate.apply(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def pii_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced inside its format."""
    return pii.apply(docs)


@stage
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document with its bin and its bytes."""
    return packing.pack(docs, contents=True)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates),
          ("benchmark_decontamination", benchmark_decontamination),
          ("pii_pseudonyms", pii_pseudonyms), ("best_fit_packing", best_fit_packing)]

ORACLE_SQL = None  # shingle groups, keyed permutations and packing are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each is written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, work in STAGES:
        found = work(spark, docs, sf_dir)
        with tables_of(OWNER):
            docs = materialise(found, name)
    return docs
