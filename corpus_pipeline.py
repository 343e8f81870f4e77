"""A training corpus from raw documents: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievestone.llm import decontamination, near_dedup, quality_rules, sentencepiece_codec, suffix_dedup
from sievestone.llm.shared import materialize

#: (name, function of (spark, docs, sf_dir)); all but the last return the columns of documents.
STAGES = [
    ("quality_rules", quality_rules.pipeline_stage),
    ("near_dedup", near_dedup.pipeline_stage),
    ("suffix_dedup", suffix_dedup.pipeline_stage),
    ("decontamination", decontamination.pipeline_stage),
    ("sentencepiece", sentencepiece_codec.pipeline_stage),
]
#: SQL has no tokenizer and no edit distance in reach of these tables: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents.  Each stage's rows are a table in the shared folder before the next begins."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
