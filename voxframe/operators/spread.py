"""Dealing of rows to as many tasks as the size of their files asks for, so that a task's memory does not grow with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of input files (Parquet) for one part.
PART_BYTES = 6_000_000
#: Where more parts than spark.shuffle.sort.bypassMergeThreshold are due, a task gathers the rows of its split (128 MB of files)
#: to sort them by part, 1.1 GB as measured, and spills; parts are made larger, up to this size, if that avoids it.
WIDE_BYTES = 20_000_000
#: What a source without a size says of it is beyond this.
UNKNOWN = 1 << 60


def input_bytes(rows: DataFrame) -> int:
    """The size of the files and local rows that a plan reads, each as often as it reads it."""
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return sum(n for n in sizes if n < UNKNOWN)


def spread(rows: DataFrame, *keys: str, part_bytes: int = PART_BYTES, always: bool = False) -> DataFrame:
    """rows dealt by keys into parts of about part_bytes of input, up to WIDE_BYTES where tasks then need not sort rows by
    part. Inputs of less than a part for each core are left as they are, or, with always, dealt as Spark does by itself."""
    size, context = 0 if rows.isStreaming else input_bytes(rows), rows.sparkSession.sparkContext
    parts, cores = -(-size // part_bytes), context.defaultParallelism
    unsorted = int(context.getConf().get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    if parts > cores:
        fits = max(cores, -(-size // WIDE_BYTES)) <= unsorted
        return rows.repartition(min(parts, unsorted) if fits else parts, *keys)
    return rows.repartition(*keys) if always else rows


def distinct_frames(rows: DataFrame, keys: list[str], *others: Column) -> DataFrame:
    """keys, stretch, n and others: the number of distinct frames in each stretch of 64, as bits of one number, so that no
    table of all frames is held. The sum of n over stretches is the number for keys; null frames count as none."""
    at = F.col("frame").cast("long")
    seen = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int")))
    return rows.groupBy(*keys, F.floor(at / 64).alias("stretch")).agg(F.bit_count(seen).cast("long").alias("n"), *others)
