"""Query op1: verdicts of the quality rules for all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxframe.llm import quality


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality.judge(docs, quality.train(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES = {"op1_quality": op1_quality}
ORACLES: dict[str, str] = {}
