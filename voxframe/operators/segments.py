"""Runs of equal states as segments, their merging, rasterising and gap filling. All by windows and range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxframe.operators.timebase import HOP_S



def by_frame():
    return W.partitionBy("rec").orderBy("frame")


def runs(states: DataFrame) -> DataFrame:
    """states(rec, frame, state) -> rec, state, first, last: maximal runs of consecutive frames of one state."""
    fresh = F.coalesce(((F.col("state") != F.lag("state").over(by_frame())) | (F.col("frame") != F.lag("frame").over(by_frame()) + 1)).cast("int"), F.lit(1))
    island = states.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(by_frame()))
    return island.groupBy("rec", "island").agg(F.first("state").alias("state"), F.min("frame").alias("first"), F.max("frame").alias("last")).drop("island")


def ipus(states: DataFrame, min_s: float = 0.2, hop_s: float = HOP_S) -> DataFrame:
    """Runs of at least min_s as half-open segments: rec, label, start_time, end_time."""
    length = (F.col("last") + 1 - F.col("first")) * F.lit(hop_s)
    return runs(states).where(length >= F.lit(min_s)).select("rec", F.col("state").alias("label"), (F.col("first") * F.lit(hop_s)).alias("start_time"), ((F.col("last") + 1) * F.lit(hop_s)).alias("end_time"))


def _gap(seconds: float) -> None:
    if seconds < 0:
        raise ValueError("the gap must not be negative")


def merge_gaps(segments: DataFrame, max_gap_s: float = 0.4) -> DataFrame:
    """Joins neighbours of one label whose gap is under max_gap_s; a merged segment ends where its last part ends."""
    _gap(max_gap_s)
    order = W.partitionBy("rec").orderBy("start_time", "end_time", "label")
    fresh = F.coalesce(((F.col("label") != F.lag("label").over(order)) | (F.col("start_time") - F.lag("end_time").over(order) >= F.lit(max_gap_s))).cast("int"), F.lit(1))
    marked = segments.withColumn("seg__i", F.row_number().over(order)).withColumn("seg__fresh", fresh).withColumn("seg__g", F.sum("seg__fresh").over(order))
    return marked.groupBy("rec", "seg__g").agg(F.first("label").alias("label"), F.min("start_time").alias("start_time"), F.max_by("end_time", "seg__i").alias("end_time")).drop("seg__g")


def merge_per_label(segments: DataFrame, max_gap_s: float = 0.4, labels: tuple[str, ...] = ("A", "B", "OVL")) -> DataFrame:
    """Each of labels merged on its own, as a decoded path is post-processed; other labels stay as they are."""
    _gap(max_gap_s)
    order = W.partitionBy("rec", "label").orderBy("start_time", "end_time")
    fresh = F.coalesce((~F.col("label").isin(*labels) | (F.col("start_time") - F.lag("end_time").over(order) >= F.lit(max_gap_s))).cast("int"), F.lit(1))
    marked = segments.withColumn("seg__i", F.row_number().over(order)).withColumn("seg__fresh", fresh).withColumn("seg__g", F.sum("seg__fresh").over(order))
    return marked.groupBy("rec", "label", "seg__g").agg(F.min("start_time").alias("start_time"), F.max_by("end_time", "seg__i").alias("end_time")).drop("seg__g")


def boundaries(states: DataFrame, hop_s: float = HOP_S) -> DataFrame:
    """rec, time_s of each change of state."""
    return states.withColumn("before", F.lag("state").over(by_frame())).where("before is not null and state != before").select("rec", (F.col("frame") * F.lit(hop_s)).alias("time_s"))


def paint_order(label: Column) -> Column:
    """Lower wins: overlap over leak over speaker A over speaker B."""
    return F.when(label == "OVL", 0).when(label == "LEAK", 1).when(label == "A", 2).otherwise(3)


def rasterize(segments: DataFrame, lengths: DataFrame, hop_s: float = HOP_S, block: int = 1000) -> DataFrame:
    """segments(rec, label, start_time, end_time) onto lengths(rec, n_frames): rec, frame, state; SIL where none is. Times
    are cut to whole frames. Each segment paints its own frames, in blocks, so that a long one is many rows' work; the frame's
    paint, or SIL, is the least by order, with one shuffle of rows summed before."""
    frame = lambda t: (F.col(t) / F.lit(hop_s)).cast("long")
    inside = lambda a, b: F.explode(F.sequence(F.greatest(F.col("block") * block, a), F.least(F.col("block") * block + block, b) - 1)).alias("frame")
    blocks = lambda a, b: F.explode(F.sequence(F.floor(a / block), F.floor((b - 1) / block))).alias("block")
    spans = segments.where(F.col("label").isin("A", "B", "OVL", "LEAK")).join(lengths, "rec").select("rec", "label", F.greatest(frame("start_time"), F.lit(0)).alias("a"), F.least(frame("end_time"), F.col("n_frames")).alias("b")).where("b > a")
    painted = spans.select("*", blocks(F.col("a"), F.col("b"))).select("rec", inside(F.col("a"), F.col("b")), F.struct(paint_order(F.col("label")).alias("order"), F.col("label").alias("state")).alias("paint"))
    grid = lengths.where("n_frames > 0").select("rec", "n_frames", blocks(F.lit(0).cast("long"), F.col("n_frames"))).select("rec", inside(F.lit(0).cast("long"), F.col("n_frames")), F.struct(F.lit(4).alias("order"), F.lit("SIL").alias("state")).alias("paint"))
    return grid.unionByName(painted).groupBy("rec", "frame").agg(F.min("paint").alias("paint")).select("rec", "frame", "paint.state")


def fill_gaps(segments: DataFrame, ends: DataFrame | None = None, label: str = "#", keys: tuple[str, ...] = ("rec",), clip: bool = False) -> DataFrame:
    """Adds segments of ``label`` where none is, from 0 to each key's end (ends(keys, xmax), or its latest end). With clip,
    starts move to the end of what came before and segments wholly before it go."""
    order = W.partitionBy(*keys).orderBy("start_time", "end_time", "label")
    live = segments.where("end_time > start_time") if clip else segments
    if clip:
        cursor = F.coalesce(F.max("end_time").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
        live = live.withColumn("gap__cursor", cursor).where(F.col("end_time") > F.greatest("gap__cursor", "start_time")).withColumn("gap__from", F.greatest("gap__cursor", "start_time"))
    else:
        live = live.withColumn("gap__cursor", F.coalesce(F.lag("end_time").over(order), F.lit(0.0))).withColumn("gap__from", F.col("start_time"))
    here = F.struct(F.col("gap__from").alias("start_time"), F.col("end_time"), F.col("label"))
    hole = F.struct(F.col("gap__cursor").alias("start_time"), F.col("start_time").alias("end_time"), F.lit(label).alias("label"))
    parts = live.select(*keys, F.explode(F.when(F.col("start_time") > F.col("gap__cursor"), F.array(hole, here)).otherwise(F.array(here))).alias("s")).select(*keys, "s.*")
    last = segments.groupBy(*keys).agg(F.max("end_time").alias("xmax")) if ends is None else ends
    at_end = live.groupBy(*keys).agg(F.max_by("end_time", F.struct("start_time", "end_time")).alias("gap__end"))
    tail = last.join(at_end, list(keys), "left").where(F.coalesce("gap__end", F.lit(0.0)) < F.col("xmax")).select(*keys, F.coalesce("gap__end", F.lit(0.0)).alias("start_time"), F.col("xmax").alias("end_time"), F.lit(label).alias("label"))
    return parts.unionByName(tail)
