"""The corpus pipeline: documents in, sampled segmentations of a balanced corpus out.

Every stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns
a DataFrame; ``run`` writes each as Parquet in the shared folder and reads it again.  All
but the last return the columns of documents.  A suffix array and sampled segmentations
have no SQL, so there is none for the pipeline; its tests compare it with a brute-force
version.

Rows without a doc_id pass all stages; NULL texts have no words and are rejected by the
first; an empty table gives an empty result; repeated rows of one id become one at the
second stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortscope.llm import jaccard, mixing, pieces, pii, quality_rules
from cohortscope.llm.common import settle, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return jaccard.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return pii.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out, so that sources meet their target weights."""
    return mixing.mix(docs)


def segmentations(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Distinct sampled segmentations of every document, with inclusion scores."""
    return pieces.encode(docs)


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates),
          ("personal data", personal_data), ("mixing", mixture),
          ("segmentations", segmentations)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
