"""Query op6: the place of every piece of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxframe.llm import packing
from voxframe.llm.scratch import stored


def vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(stored(packing.pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary()), "pack-pieces"))


QUERIES = {"op6_packing": op6_packing}
ORACLES: dict[str, str] = {}
