"""A corpus pipeline: five of the operators in a row, each stage written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorekeep.llm import line_dedup, piece_encoding, quality_classifier, simhash_dedup, source_mixing
from lorekeep.llm.common import new_folder, remove, table

STAGES = [
    ("quality classifier", quality_classifier.stage),
    ("line dedup", line_dedup.stage),
    ("simhash near-dedup", simhash_dedup.stage),
    ("mixing sources", source_mixing.stage),
    ("piece encoding", piece_encoding.stage),
]

#: No SQL expresses the classifier's fit or the model's merges; tests/llm/test_pipeline.py holds run() against plain versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote goes when the next has read it; the last goes with the application."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = new_folder(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
