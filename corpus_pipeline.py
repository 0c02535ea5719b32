"""The corpus pipeline: documents in, a decontaminated, deduplicated and weighted training mixture out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next one's docs.
All but the last return the columns of ``documents``; the last adds the mixture.

Defined cases: a null text is clean and no near duplicate, and is an empty text from the third stage on; null ids are never near
duplicates and lose passages to every other id; of repeated rows of one id all stay that are not near duplicates of a smaller id's;
columns of ``documents`` beyond the five are not carried; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreline.llm._frames import shared_dir
from loreline.llm.decontam import drop_contaminated
from loreline.llm.jaccard_join import keep_one
from loreline.llm.mixing import LANG_TARGETS, lang_labels, mix_sources
from loreline.llm.substring_dedup import substring_dedup
from loreline.llm.toxicity import score_toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents graded toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_toxicity(docs, labels, keep=COLUMNS[1:])
    return scored.filter(~F.col("toxic")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return keep_one(docs).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that stand in an earlier document go; every document stays."""
    cut = substring_dedup(docs, keep=("lang", "source"))
    return cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its rate in the target mixture; those with rate 0 take no part in it."""
    labels = lang_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    mixed = mix_sources(docs, labels, LANG_TARGETS, keep=COLUMNS[1:])
    return mixed.filter("rate > 0").select(*COLUMNS, "n_words", "domain", "rate", "copies")


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("decontamination", decontamination), ("mixture", mixture)]

# Toxicity and mixing are trained models, which SQL cannot express; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each one's result is written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
