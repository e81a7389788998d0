"""Query op7: main text of every page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.llm import extraction


def op7_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.char_length("text").cast("long"))


QUERIES = {"op7_extraction": op7_extraction}
ORACLES: dict[str, str] = {}
