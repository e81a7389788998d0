"""End to end: recordings to tracks, scores, state path, segments, counters, transcripts and documents, in one plan for all
recordings."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxframe.operators import chunking, decode, evaluation, fusion, metrics, segments, signal, spectral, textgrid, transcript, vad
from voxframe.operators.timebase import HOP_S
from voxframe.plans.steps import VERSION, Registry, Step
from voxframe.sources import artifacts, audio, files

SMOOTH_MS, MIN_IPU_S, LEAK_WINDOW_S = 80.0, 0.2, 0.025
#: Labels that are recognised, each on its channel.
SPEAKERS = ("A", "B", "OVL")


@dataclass
class Annotation:
    tracks: DataFrame
    path: DataFrame
    segments: DataFrame
    diagnostics: DataFrame


def evidence(frames: DataFrame, with_leakage: bool = False, inspect: bool = False) -> DataFrame:
    """frames(rec, rate, frame, left, right) -> vad, diar_a, diar_b, overlap_proxy and, if asked, leakage_likelihood, from
    windows of LEAK_WINDOW_S, and the tracks that decoding does not use: energy_rms, energy_smooth, energy_slope, voiced_soft,
    log_ratio, correlation. The speakers are null where both channels are the same recording, as their dominance means
    nothing there."""
    mono = F.transform(F.arrays_zip("left", "right"), lambda x: (x.left + x.right) / 2)
    energy = signal.energies(frames).withColumn("energy_rms", signal.rms(mono))
    energy = energy.withColumn("energy_smooth", signal.smooth(F.col("energy_rms"), signal.window_frames(SMOOTH_MS, HOP_S)))
    extra: list[str] = []
    if inspect:
        energy = energy.withColumn("log_ratio", signal.log_ratio(F.col("energy_left"), F.col("energy_right"))).withColumn("correlation", signal.correlation(F.col("left"), F.col("right")))
        for name, c in signal.slope(F.col("energy_smooth"), HOP_S):
            energy = energy.withColumn(name, c)
        energy = energy.withColumnRenamed("slope", "energy_slope")
        extra = ["energy_rms", "energy_smooth", "energy_slope", "voiced_soft", "log_ratio", "correlation"]
    pairs = frames.where(F.col("frame") < int(30 / HOP_S)).select("rec", F.explode(F.arrays_zip("left", "right")).alias("s")).select("rec", F.col("s.left").alias("l"), F.col("s.right").alias("r"))
    alike = signal.channel_similarity(pairs).select("rec", (F.col("label") == "same").alias("same"))
    bare = energy.drop("left", "right")
    if vad.installed():
        heard = bare.join(vad.soft_vad(frames.select("rec", "frame", mono.alias("samples"))), ["rec", "frame"])
    else:
        heard = signal.energy_vad(bare, "energy_smooth")
    out = signal.diarization(heard).withColumn("voiced_soft", F.col("vad")).join(alike, "rec", "left")
    speaker = lambda c: F.when(~F.coalesce("same", F.lit(False)), F.col(c)).alias(c)
    out = out.withColumn("overlap_proxy", signal.overlap_proxy(F.col("diar_a"), F.col("diar_b")))
    out = out.select("rec", "frame", "vad", *map(speaker, ("diar_a", "diar_b", "overlap_proxy")), *extra)
    if with_leakage:
        width = F.round((F.col("rate") if "rate" in frames.columns else F.size("left") / F.lit(HOP_S)) * F.lit(LEAK_WINDOW_S)).cast("int")
        leak = spectral.leakage(frames, width).select("rec", "frame", F.col("leakage").alias("leakage_likelihood"))
        out = out.join(leak, ["rec", "frame"])
    return out


def cached_evidence(spark: SparkSession, folder: str, cache: str, with_leakage: bool = False) -> DataFrame:
    """evidence() of the recordings in folder, computed only for files that the cache does not have: a file is known by its
    path, size and time of change, and the options. The files' contents are read for new ones alone."""
    options = json.dumps({"with_leakage": with_leakage, "version": VERSION})
    held = audio.files(spark, folder, described=True).withColumn("key", F.sha1(F.to_json(F.struct("rec", "length", "modificationTime", F.lit(options).alias("options"))).cast("binary")))
    now = held.select("rec", "key")
    tracks = f"{cache.rstrip('/')}/evidence"
    new = held.join(spark.read.parquet(tracks).select("key").distinct(), "key", "left_anti") if files.exists(spark, tracks) else held
    if not new.isEmpty():
        evidence(audio.frames(new.select("rec", "content")), with_leakage).join(now, "rec").write.mode("append").partitionBy("key").parquet(tracks)
    return spark.read.parquet(tracks).join(now.select("key"), "key", "left_semi").drop("key")


def kept(out: str) -> Callable[[DataFrame, str], DataFrame]:
    """Writes a table below out once and goes on from what is stored."""

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{out}/{name}")
        return df.sparkSession.read.parquet(f"{out}/{name}")

    return keep


def decoded(tracks: DataFrame, tuning: decode.Tuning = decode.Tuning(), min_ipu_s: float = MIN_IPU_S, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> Annotation:
    """Path, segments and counters of tracks."""
    path = keep(decode.decode(fusion.fuse(tracks, tuning), tuning), "path")
    found = segments.merge_per_label(segments.ipus(path, min_ipu_s), tuning.merge_gap_ms / 1000)
    return Annotation(tracks, path, found, metrics.run_counters(path, found))


def annotate(frames: DataFrame, tuning: decode.Tuning = decode.Tuning(), min_ipu_s: float = MIN_IPU_S, with_leakage: bool = False, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> Annotation:
    """Tracks, path, segments and counters. With keep, tracks and path are stored once, and all else starts from them."""
    return decoded(keep(evidence(frames, with_leakage), "evidence"), tuning, min_ipu_s, keep)


def annotate_files(spark: SparkSession, folder: str, tuning: decode.Tuning = decode.Tuning(), **options: Any) -> Annotation:
    return annotate(audio.frames(audio.files(spark, folder)), tuning, **options)


def recognise(found: DataFrame, durations: DataFrame, backend: Callable, stereo: bool = True, channel: int | None = None) -> DataFrame:
    """What the recogniser hears in windows of each speaker's segments, on the speaker's channel: rec, start_time, end_time,
    text, speaker. Each speaker's windows are merged on their own."""
    spoken = found.where(F.col("label").isin(*SPEAKERS)).join(durations, "rec")
    windows = chunking.asr_chunks(spoken.select("rec", "label", "start_time", "end_time", "duration_s"))
    windows = windows.withColumn("channel", transcript.channel_of(F.col("label"), stereo, channel))
    parts = [transcript.assign_speaker(transcript.transcribe(windows.where(F.col("label") == s), backend), F.lit(s)) for s in SPEAKERS]
    return transcript.merge(*parts)


def on_segments(said: DataFrame, found: DataFrame) -> DataFrame:
    """Recognised words back on the segments that they belong to, their speaker's if they have one."""
    words = said.select("rec", F.col("text").alias("word"), "start_time", "end_time", *(["speaker"] if "speaker" in said.columns else []))
    numbered = found.where(F.col("label") != "SIL").withColumn("ipu", F.row_number().over(W.partitionBy("rec").orderBy("start_time", "label")) - 1)
    if "speaker" not in said.columns:
        return transcript.align(words, numbered)
    parts = [transcript.align(words.where(F.col("speaker") == s), numbered.where(F.col("label") == s)) for s in SPEAKERS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def lengths_of(path: DataFrame) -> DataFrame:
    return path.groupBy("rec").agg((F.count("*") * F.lit(HOP_S)).alias("duration_s"))


def transcribe(annotation: Annotation, durations: DataFrame, backend: Callable) -> DataFrame:
    """Recogniser windows of each speaker's segments, their words, and the words back on the segments."""
    return on_segments(recognise(annotation.segments, durations, backend), annotation.segments)


def steps(backend: Callable | None = None, tuning: decode.Tuning = decode.Tuning(), min_ipu_s: float = MIN_IPU_S) -> Registry:
    """The graph from frames to evidence, decode, diagnostics, transcription and alignment. Only what a target needs runs;
    given segments or a transcript, the steps before them do not."""
    graph = Registry()

    def paths(state: Mapping[str, Any]) -> dict[str, Any]:
        path = decode.decode(fusion.fuse(state["tracks"], tuning), tuning)
        return {"path": path, "segments": segments.merge_per_label(segments.ipus(path, min_ipu_s), tuning.merge_gap_ms / 1000)}

    def heard(state: Mapping[str, Any]) -> dict[str, Any]:
        if backend is None:
            raise ValueError("transcription needs a recogniser")
        return {"transcript": recognise(state["segments"], lengths_of(state["path"]), backend)}

    graph.register(Step("evidence", ("frames",), ("tracks",), lambda s: {"tracks": evidence(s["frames"])}))
    graph.register(Step("decode", ("tracks",), ("path", "segments"), paths, {"tuning": asdict(tuning), "min_ipu_s": min_ipu_s}))
    graph.register(Step("diagnostics", ("path",), ("diagnostics",), lambda s: {"diagnostics": decode.counters(s["path"])}))
    graph.register(Step("transcription", ("path", "segments"), ("transcript",), heard))
    graph.register(Step("alignment", ("transcript", "segments"), ("alignment",), lambda s: {"alignment": on_segments(s["transcript"], s["segments"])}))
    return graph


def write_run(annotation: Annotation, out: str | Path) -> None:
    """Tracks as Parquet, if they are not stored there already, states, segments and diagnostics as typed JSON, TextGrids as
    text. Give an annotation made with kept(out), so that tracks and path are computed once."""
    spans = lambda df: df.groupBy("rec").agg(F.array_sort(F.collect_list(F.struct("start", "end", "label"))).alias("s"))  # noqa: E731  one recording
    as_json = lambda df: spans(df).select("rec", F.transform("s", lambda x: F.struct(x.label.alias("label"), x.start.alias("start"), x.end.alias("end"))).alias("segments"))
    seconds = lambda df, a, b: df.select("rec", "label", F.col(a).alias("start"), F.col(b).alias("end"))
    runs = segments.runs(annotation.path).select("rec", F.col("state").alias("label"), (F.col("first") * HOP_S).alias("start"), ((F.col("last") + 1) * HOP_S).alias("end"))
    spark = annotation.tracks.sparkSession
    if not files.exists(spark, f"{out}/evidence/_SUCCESS"):
        annotation.tracks.write.mode("overwrite").parquet(f"{out}/evidence")
    artifacts.write(as_json(runs), "states", f"{out}/states")
    artifacts.write(as_json(seconds(annotation.segments.where("label != 'SIL'"), "start_time", "end_time")), "ipus", f"{out}/ipus")
    counts = F.map_from_arrays(F.array(*[F.lit(c) for c in annotation.diagnostics.columns if c != "rec"]), F.array(*[F.col(c).cast("double") for c in annotation.diagnostics.columns if c != "rec"]))
    artifacts.write(annotation.diagnostics.select("rec", counts.alias("metrics")), "diagnostics", f"{out}/diagnostics")
    tier = F.element_at(F.create_map(*[F.lit(x) for kv in textgrid.TIER_OF.items() for x in kv]), F.col("label"))
    named = annotation.segments.where("label != 'SIL'").select("rec", tier.alias("tier"), "start_time", "end_time", "label")
    textgrid.render(named).select("rec", "document").write.mode("overwrite").parquet(f"{out}/textgrids")


def write_transcript(annotation: Annotation, said: DataFrame, out: str | Path) -> None:
    """Transcript and alignment as typed JSON, and both kinds of TextGrids, of what was recognised."""
    held = kept(str(out))(said, "recognised")
    aligned = kept(str(out))(on_segments(held, annotation.segments), "aligned")
    word = F.struct(F.col("text"), F.col("start_time").alias("start"), F.col("end_time").alias("end"), "speaker", F.lit(None).cast("double").alias("confidence"))
    gathered = held.groupBy("rec").agg(F.collect_list(word).alias("words"))  # one recording's
    artifacts.write(gathered.withColumn("language", F.lit(None).cast("string")), "transcript", f"{out}/transcript")
    artifacts.write(gathered, "alignment", f"{out}/alignment")
    spoken = aligned.select("rec", F.col("label").alias("speaker"), "start_time", "end_time", "text")
    textgrid.transcript_document(spoken, held.select("rec", "speaker", "start_time", "end_time", F.col("text").alias("word"))).write.mode("overwrite").parquet(f"{out}/transcript_textgrids")
    timed = lambda df, label: df.select("rec", "start_time", "end_time", F.col(label).alias("label"))
    runs = segments.runs(annotation.path).select("rec", F.col("state").alias("label"), (F.col("first") * HOP_S).alias("start_time"), ((F.col("last") + 1) * HOP_S).alias("end_time"))
    textgrid.annotation_document(words=timed(held, "text"), ipus=timed(annotation.segments.where("label != 'SIL'"), "label"), states=runs).write.mode("overwrite").parquet(f"{out}/annotation_textgrids")


def evaluate(items: DataFrame, annotation: Annotation, references: DataFrame) -> DataFrame:
    """Scorecard of items(id, tier, rec); items without a path failed."""
    rows = metrics.scores(references, annotation.path, annotation.segments)
    joined = items.select("id", "tier", "rec").join(rows, "rec", "left")
    return evaluation.with_failures(items.select("id", "tier"), joined.drop("rec", "tier"))
