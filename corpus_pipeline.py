"""The corpus pipeline: five of the operators, each over all that the one before it kept.

Every stage's result is written as Parquet to the shared folder and read again, so a lost executor costs a
stage's tasks and not the stages before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidence_engine.llm import jaccard, mixing, quality, tokens, winnow
from evidence_engine.llm.shared import discard_since, made, settled

STAGES = [
    ("quality", quality.stage),
    ("near_duplicates", jaccard.stage),
    ("decontamination", winnow.stage),
    ("mixing", mixing.stage),
    ("token_ids", tokens.stage),
]

#: Learned rules, random draws and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage returns. A stage's own scratch and its input go as soon as its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = made()
    for name, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard_since(spark, since, docs)
    return docs
