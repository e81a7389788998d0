"""Streaming forms of framing, smoothing and gap merging: windowed aggregates with watermarks, state bounded by them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def framed(samples: DataFrame, hop: str = "10 milliseconds", late: str = "1 second") -> DataFrame:
    """samples(rec, ts, value) -> rec, start, energy: root mean square per tumbling window."""
    per = samples.withWatermark("ts", late).groupBy("rec", F.window("ts", hop).alias("w")).agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("energy"))
    return per.select("rec", F.col("w.start").alias("start"), "energy")


def smoothed(samples: DataFrame, width: str = "80 milliseconds", hop: str = "10 milliseconds", late: str = "1 second") -> DataFrame:
    """Mean over sliding windows."""
    per = samples.withWatermark("ts", late).groupBy("rec", F.window("ts", width, hop).alias("w")).agg(F.avg("value").alias("value"))
    return per.select("rec", F.col("w.start").alias("start"), "value")


def sessions(active: DataFrame, gap: str = "400 milliseconds", late: str = "1 second") -> DataFrame:
    """active(rec, label, ts): frames of speech -> segments that pauses of ``gap`` or more part."""
    per = active.withWatermark("ts", late).groupBy("rec", "label", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_frames"), F.min("ts").alias("start"), F.max("ts").alias("last"))
    return per.select("rec", "label", "start", "last", "n_frames")
