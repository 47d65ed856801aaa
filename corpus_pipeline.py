"""A corpus pipeline: five stages, each over all that the stage before it kept.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.

Docs has doc_id, text and source, and any other columns, of any names and types, which go along. In all stages a null
text counts as an empty one (and stays null), texts are read whole however long they are, a null doc_id is an id after
all others, and an empty table gives an empty one. Repeated rows are dealt with alike, each by itself, but for the
second stage, which leaves one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fathomline.llm import decontaminate, mixing, near_dedup, pii, toxicity
from fathomline.llm.session import scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity model, fitted on the labelled rows of docs, scores 0.5 or more.

    With too few labels of either kind to learn from, all get the mean label: then none goes, unless most are toxic.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.clean(docs, toxicity.fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id (of several of its rows, one).

    Null and empty texts are one group; texts without words are near their equals only.
    """
    return near_dedup.dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that benchmark texts contaminate. Documents and items without words contaminate nothing."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind in angle brackets; n_chars, where there is one, is brought up to date."""
    return pii.mask(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with size, source_size, target and taken, the words that the mix takes of each; a null source is one of its own.

    Columns of docs with these four names give way to them.
    """
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
]

#: A fitted classifier, consistent sampling and the transducers aren't SQL; tests hold run() against each stage's own checks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each result is written as Parquet to the shared folder and read again."""
    where = scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{name}")
        docs = spark.read.parquet(f"{where}/{name}")
    return docs
