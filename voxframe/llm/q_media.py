"""Query op9: every text as an image, read back, with its perceptual hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.llm import media


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = media.features(media.encode(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return seen.withColumn("feature", F.lower(F.hex("phash"))).drop("phash")


QUERIES = {"op9_media": op9_media}
ORACLES: dict[str, str] = {}
