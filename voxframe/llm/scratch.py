"""Shared scratch tables: lineage cuts that every executor and the driver can read."""

from __future__ import annotations

import tempfile
import uuid

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def root(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a folder of our own only where that is unset (tests, local runs)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if held:
        return held.rstrip("/")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="voxframe_"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


class Owner:
    """Knows the tables that are stored while it is entered, and can remove them once nothing reads them any more."""

    _all: list[Owner] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Owner:
        Owner._all.append(self)
        return self

    def __exit__(self, *_) -> None:
        Owner._all.remove(self)

    def remove(self, keep: Iterable[str] = ()) -> None:
        held = set(keep)
        for path in [p for p in self.paths if p not in held]:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
            self.paths.remove(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: its lineage ends there, lost executors reread files.

    Empty schemas apart, any DataFrame works. The folder is unique per call; an Owner that is entered can remove it. Otherwise
    it stays until the owner of spark.checkpoint.dir removes it, because the returned DataFrame is lazy and reads it later.
    """
    spark = df.sparkSession
    path = f"{root(spark)}/tables/{name}-{uuid.uuid4().hex}"
    for owner in Owner._all:
        owner.paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """names, each with a number behind it where columns have it already, in whatever case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        free = next(n for n in (name, *(f"{name}_{k}" for k in range(1, len(taken) + 2))) if n.lower() not in taken)
        taken.add(free.lower())
        out.append(free)
    return out


def own(df: DataFrame) -> list[Column]:
    """The columns of df, whatever their names hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def split_join(left: DataFrame, right: DataFrame, key: str | list[str], how: str = "inner") -> DataFrame:
    """left joined to right by key, where right is a sum by key. Spark would join in the partitions of that sum, and a hot
    key's rows of left would stay in one task; dealt by the key and its hash both sides have plain shuffles, which adaptive
    execution splits."""
    keys = [key] if isinstance(key, str) else key
    beside = unused([*left.columns, *right.columns], "dealt")[0]
    return left.withColumn(beside, F.xxhash64(*keys)).join(right.withColumn(beside, F.xxhash64(*keys)), [*keys, beside], how).drop(beside)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
