"""Transcripts: words in segments, their speakers, duplicates and alignment to speech segments."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TOLERANCE_S, SAME_S, SHORTEST_S = 1e-3, 1e-6, 1e-4
CHUNK_SCHEMA = "rec long, start_time double, end_time double, text string"


def assign_speaker(segments: DataFrame, speaker: Column) -> DataFrame:
    """Stamps a speaker on segments and, where they have them, on their words."""
    out = segments.withColumn("speaker", speaker)
    return out.withColumn("words", F.transform("words", lambda w: w.withField("speaker", F.col("speaker")))) if "words" in segments.columns else out


def merge(*transcripts: DataFrame) -> DataFrame:
    """All segments with order, their rank in the recording by start, end, speaker (null first as empty) and text."""
    out = transcripts[0]
    for t in transcripts[1:]:
        out = out.unionByName(t)
    return out.withColumn("order", F.row_number().over(W.partitionBy("rec").orderBy("start_time", "end_time", F.coalesce("speaker", F.lit("")), "text")) - 1)


def deduplicate(words: DataFrame) -> DataFrame:
    """words(rec, word, start_time, end_time, speaker): of words equal in text, speaker and times to the millisecond, the
    first by start, end, word and speaker."""
    tick = lambda c: F.bround(F.col(c) / F.lit(TOLERANCE_S)).cast("long")
    key = W.partitionBy("rec", "word", tick("start_time"), tick("end_time"), "speaker").orderBy("start_time", "end_time")
    return words.withColumn("dup__n", F.row_number().over(key)).where("dup__n = 1").drop("dup__n")


def belongs(word_start: Column, word_end: Column, start: Column, end: Column) -> Column:
    middle = (word_start + word_end) / F.lit(2.0)
    return ((middle >= start) & (middle <= end)) | (F.least(word_end, end) > F.greatest(word_start, start))


def align(words: DataFrame, ipus: DataFrame, bucket_s: float = 10.0) -> DataFrame:
    """words(rec, word, start_time, end_time) and ipus(rec, ipu, label, start_time, end_time) -> rec, ipu, label, start_time,
    end_time, n_words, text: the words of each segment that has any, clipped to it. A word may be in several segments. They
    meet on (rec, stretch of bucket_s seconds), so no recording is one nested loop."""
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / F.lit(bucket_s)), F.floor(F.col(b) / F.lit(bucket_s))))
    w = deduplicate(words.withColumn("speaker", F.lit(None).cast("string")) if "speaker" not in words.columns else words)
    w = w.select("rec", "word", F.col("start_time").alias("ws"), F.col("end_time").alias("we"), "speaker").withColumn("bucket", span("ws", "we"))
    s = ipus.withColumn("bucket", span("start_time", "end_time"))
    pairs = w.join(s, ["rec", "bucket"]).where(belongs(F.col("ws"), F.col("we"), F.col("start_time"), F.col("end_time")))
    # a pair that shares several stretches counts in the first
    pairs = pairs.where(F.col("bucket") == F.floor(F.greatest("ws", "start_time") / F.lit(bucket_s)))
    kept = pairs.where(F.least("we", "end_time") > F.greatest("ws", "start_time"))
    order = F.array_sort(F.collect_list(F.struct("ws", "we", "word", F.coalesce("speaker", F.lit("")).alias("sp"))))  # words of one segment
    return kept.groupBy("rec", "ipu", "label", "start_time", "end_time").agg(F.count("*").alias("n_words"), F.array_join(F.transform(order, lambda x: x.word), " ").alias("text"))


def recognised(raw: DataFrame) -> DataFrame:
    """Recogniser output (rec, chunk_start, chunk_end, start_time, end_time, text), times within the chunk -> segments in
    recording time, clamped to the chunk; shorter than SHORTEST_S go."""
    clamp = lambda c: F.least(F.greatest(F.col("chunk_start") + F.col(c), F.col("chunk_start")), F.col("chunk_end"))
    out = raw.select("rec", clamp("start_time").alias("start_time"), clamp("end_time").alias("end_time"), F.trim("text").alias("text"))
    return out.where(F.col("end_time") - F.col("start_time") >= F.lit(SHORTEST_S))


def merge_adjacent(segments: DataFrame) -> DataFrame:
    """Without empty texts, and without repeats, in text and times, of the last segment that was kept. Only neighbours with
    one text and starts side by side can repeat each other, so the fold runs over such runs, not over recordings."""
    order = W.partitionBy("rec").orderBy("start_time", "end_time", "text")
    apart = (F.col("text") != F.lag("text").over(order)) | (F.col("start_time") - F.lag("start_time").over(order) >= F.lit(SAME_S))
    live = segments.where(F.trim("text") != "").select(F.struct("*").alias("row"), "rec", "text", "start_time", "end_time")
    runs = live.withColumn("run", F.count_if(F.coalesce(apart, F.lit(True))).over(order))
    ordered = F.array_sort(F.collect_list(F.struct("start_time", "end_time", "row")))  # segments that all but coincide
    near = lambda a, b: (F.abs(a.start_time - b.start_time) < F.lit(SAME_S)) & (F.abs(a.end_time - b.end_time) < F.lit(SAME_S))
    kept = F.aggregate("all", F.slice("all", 1, 1), lambda held, x: F.when(near(F.element_at(held, -1), x), held).otherwise(F.concat(held, F.array(x))))
    return runs.groupBy("rec", "run").agg(ordered.alias("all")).select(F.explode(kept).alias("x")).select("x.row.*")


def transcribe(chunks: DataFrame, backend: Callable[[], Callable[[dict], list[tuple[float, float, str]]]]) -> DataFrame:
    """Runs a recogniser over chunks. backend() is called once a task and gives a function from a chunk's columns to
    (start, end, text) within the chunk; what it gives is put in recording time and merged."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        recognise = backend()
        for batch in batches:
            rows = [(c["rec"], c["start_time"], c["end_time"], s, e, t) for c in batch.to_dict("records") for s, e, t in recognise(c)]
            yield pd.DataFrame(rows, columns=["rec", "chunk_start", "chunk_end", "start_time", "end_time", "text"])

    rec = chunks.schema["rec"].dataType.simpleString()
    return merge_adjacent(recognised(chunks.mapInPandas(run, f"rec {rec}, chunk_start double, chunk_end double, start_time double, end_time double, text string")))


def channel_of(label: Column, stereo: bool, channel: int | None = None) -> Column:
    """The channel to recognise a speaker on: A left, B right, overlap both (null); without stereo always ``channel``."""
    if not stereo:
        return F.lit(channel).cast("int")
    return F.when(label == "A", F.lit(0)).when(label == "B", F.lit(1))
