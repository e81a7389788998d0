"""Query op10: spans of secrets in every document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.llm import secrets


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("base", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")
    place = F.array(*[F.lit(k) for k in secrets.KINDS])
    # by start, then kind as listed
    merged = F.transform(
        F.array_sort(F.transform(F.concat("base", "added"), lambda x: F.struct(x.start.alias("start"), F.array_position(place, x.kind).alias("place"), x.end.alias("end"), x.kind.alias("kind")))),
        lambda x: F.struct(x.kind.alias("kind"), x.start.alias("start"), x.end.alias("end")),
    )
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(merged).alias("spans"))


QUERIES = {"op10_secrets": op10_secrets}
ORACLES: dict[str, str] = {}
