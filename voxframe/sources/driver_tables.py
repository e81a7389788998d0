"""Domain tables as projections of the driver's tables. Each has a SQL twin of the same name, for oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxframe.operators.spread import spread

HOLD = 16
#: Conversation turns of one part; their words take some 30 kB each to sort.
TURNS_A_PART = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held(spark: SparkSession, sf_dir: str, columns: dict[str, Column]) -> DataFrame:
    """Each supplier's line items in order, with the columns of the first of each HOLD. One sort serves both windows."""
    order = W.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax")
    numbered = spread(items, "l_suppkey").withColumn("frame", (F.row_number().over(order) - 1).cast("long"))
    first = F.when(F.col("frame") % HOLD == 0, F.struct(*(c.alias(n) for n, c in columns.items())))
    held = numbered.withColumn("held", F.last(first, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return held.select(F.col("l_suppkey").alias("rec"), "frame", "held.*")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec, frame, vad, diar_a, diar_b, leak: supplier as recording, line items in time as frames, held over HOLD frames."""
    return _held(spark, sf_dir, {"vad": F.col("l_quantity") / F.lit(50.0), "diar_a": F.col("l_discount") * F.lit(10.0), "diar_b": F.col("l_tax") * F.lit(12.5), "leak": (F.col("l_partkey") % 10).cast("double") / F.lit(9.0)})


def raw_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec, frame and five scores in which every state wins somewhere."""
    return _held(
        spark, sf_dir,
        {"s_sil": F.col("l_quantity") / F.lit(50.0), "s_a": F.col("l_discount") * F.lit(10.0), "s_b": F.col("l_tax") * F.lit(12.5), "s_ovl": (F.col("l_partkey") % 10).cast("double") / F.lit(9.0), "s_leak": (F.col("l_orderkey") % 7).cast("double") / F.lit(6.0)},
    )


_ORDERED = "ordered as (select *, l_suppkey as rec, row_number() over (partition by l_suppkey order by l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1 as frame from lineitem)"
_BLOCK = f"window b as (partition by l_suppkey, frame // {HOLD} order by frame)"
FRAMES = f"""{_ORDERED},
frames as (select rec, frame, first_value(l_quantity / 50::double) over b as vad, first_value(l_discount * 10::double) over b as diar_a, first_value(l_tax * 12.5::double) over b as diar_b, first_value((l_partkey % 10)::double / 9::double) over b as leak from ordered {_BLOCK})"""
RAW_SCORES = f"""{_ORDERED},
scores as (select rec, frame, first_value(l_quantity / 50::double) over b as s_sil, first_value(l_discount * 10::double) over b as s_a, first_value(l_tax * 12.5::double) over b as s_b, first_value((l_partkey % 10)::double / 9::double) over b as s_ovl, first_value((l_orderkey % 7)::double / 6::double) over b as s_leak from ordered {_BLOCK})"""


def stereo_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec, frame, left, right: pairs of neighbouring vectors as frames of 64 samples."""
    vec = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 100).alias("rec"), F.floor((F.col("vec_id") % 100) / 2).alias("frame"), (F.col("vec_id") % 2).alias("side"), F.col("embedding").cast("array<double>").alias("v"))
    pair = vec.groupBy("rec", "frame").agg(F.max(F.when(F.col("side") == 0, F.col("v"))).alias("left"), F.max(F.when(F.col("side") == 1, F.col("v"))).alias("right"))
    return pair.where("left is not null and right is not null")


STEREO = """stereo as (select l.vec_id // 100 as rec, (l.vec_id % 100) // 2 as frame, l.embedding::double[] as "left", r.embedding::double[] as "right"
 from embeddings l join embeddings r on r.vec_id = l.vec_id + 1 where l.vec_id % 2 = 0)"""


def event_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec, frame, state: a user's events in time, by type."""
    names = {"view": "A", "click": "B", "purchase": "OVL", "error": "LEAK"}
    state = F.lit("SIL")
    for kind, s in names.items():
        state = F.when(F.col("event_type") == kind, F.lit(s)).otherwise(state)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("rec"), (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long").alias("frame"), state.alias("state"))


EVENT_STATES = """states as (select user_id as rec, row_number() over (partition by user_id order by ts, event_id) - 1 as frame,
 case event_type when 'view' then 'A' when 'click' then 'B' when 'purchase' then 'OVL' when 'error' then 'LEAK' else 'SIL' end as state from events)"""


def event_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec, frame, value: the mean value of a user's events each day, days counted from 2024."""
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000) - 19_723
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("rec"), day.alias("frame")).agg(F.avg("value").alias("value"))


EVENT_TRACK = """track as (select user_id as rec, epoch_us(ts) // 86400000000 - 19723 as frame, avg(value) as value from events group by all)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec, turn, label, start_time, end_time, text: the turns of a conversation one after another, with pauses."""
    w = W.partitionBy("conv_id").orderBy("turn")
    dur = F.greatest(F.lit(0.1), F.length("text").cast("double") * F.lit(0.06))
    label = F.when(F.col("role") == "user", "A").when(F.col("role") == "assistant", "B").otherwise("SIL")
    rows = table(spark, sf_dir, "conversations")
    # parts by turns, as repeated texts are small in a file; the count reads footers only
    parts = rows.count() // TURNS_A_PART
    rows = rows.repartition(parts, "conv_id") if parts > spark.sparkContext.defaultParallelism else rows
    t = rows.select("conv_id", "turn", label.alias("label"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(dur, F.lit(0.1)).alias("dur"))
    start = F.round(F.coalesce(F.sum("dur").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)) + F.lit(0.25) * F.col("turn"), 4)
    return t.withColumn("start_time", start).select(F.col("conv_id").alias("rec"), "turn", "label", "start_time", F.round(F.col("start_time") + F.col("dur"), 4).alias("end_time"), "text")


TURNS = """timed as (select conv_id, turn, case role when 'user' then 'A' when 'assistant' then 'B' else 'SIL' end as label, coalesce(text, '') as text, coalesce(greatest(0.1::double, length(text)::double * 0.06::double), 0.1::double) as dur from conversations),
started as (select *, round(coalesce(sum(dur) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0::double) + 0.25::double * turn, 4) as start_time from timed),
turns as (select conv_id as rec, turn, label, start_time, round(start_time + dur, 4) as end_time, text from started)"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec, turn, i, word, start_time, end_time, speaker: a turn's words evenly over its time, in whole tenths of a ms."""
    ticks = lambda c: F.round(F.col(c) * 10000.0).cast("long")
    t = turns(spark, sf_dir).withColumn("w", F.split("text", " ")).withColumn("a", ticks("start_time")).withColumn("n", ticks("end_time") - ticks("start_time"))
    each = t.select("rec", "turn", "label", "a", "n", F.size("w").alias("size"), F.posexplode("w").alias("i", "word"))
    at = lambda k: (F.col("a") + F.floor(k * F.col("n") / F.col("size"))).cast("double") / F.lit(10000.0)
    return each.select("rec", "turn", "i", "word", at(F.col("i")).alias("start_time"), at(F.col("i") + 1).alias("end_time"), F.col("label").alias("speaker"))


WORDS = """split as (select *, string_split(text, ' ') as w, round(start_time * 10000)::bigint as a, round(end_time * 10000)::bigint - round(start_time * 10000)::bigint as n from turns),
spread as (select rec, turn, label, a, n, len(w) as size, unnest(w) as word, unnest(range(0, len(w))) as i from split),
words as (select rec, turn, i, word, (a + i * n // size)::double / 10000 as start_time, (a + (i + 1) * n // size)::double / 10000 as end_time, label as speaker from spread)"""
