"""Fusion of evidence tracks into log scores of the five states, as one projection over the wide frame table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.operators.spread import distinct_frames

from voxframe.operators.decode import Tuning
from voxframe.operators.signal import as_probability
from voxframe.operators.tracks import wide

# fixed values of the score model
LOG_EPS = 1e-6
W_OVERLAP, W_PROXY, OVERLAP_BONUS, W_PRIOR, LEAK_SILENCE, LEAK_BASE, HIGH_RECALL_SILENCE = 1.5, 0.5, 0.4, 0.4, 0.5, -3.0, -1.0
SCORES = ("s_sil", "s_a", "s_b", "s_ovl", "s_leak")
TRACKS = ("vad", "diar_a", "diar_b", "leak", "overlap_proxy")


def clipped_log(p: Column) -> Column:
    return F.log(F.least(F.greatest(p, F.lit(LOG_EPS)), F.lit(1.0 - LOG_EPS)))


def leak_alias(frames: DataFrame) -> Column:
    """leakage_likelihood, or else leak, as tracks: the first that the table has."""
    for name in ("leakage_likelihood", "leak"):
        if name in frames.columns:
            return F.col(name)
    return F.lit(None).cast("double")


def fuse(frames: DataFrame, tuning: Tuning = Tuning(), logits: tuple[str, ...] = (), keep: tuple[str, ...] = ("rec", "frame")) -> DataFrame:
    """frames(rec, frame, tracks...) -> rec, frame and the five scores. A missing track column counts as 0.5 for vad and
    the speakers, and leaves out its term for leak and overlap_proxy; a null in a column that is there does the same for
    its recording. prior_a and prior_b are additive offsets. logits names the tracks that hold logits."""

    def track(name: str) -> Column:
        value = leak_alias(frames) if name == "leak" else F.col(name) if name in frames.columns else F.lit(None).cast("double")
        return as_probability(value, "logit") if name in logits else value

    half = lambda name: F.coalesce(track(name), F.lit(0.5))
    speech, silence = clipped_log(half("vad")), clipped_log(F.lit(1.0) - half("vad"))
    a, b = clipped_log(half("diar_a")), clipped_log(half("diar_b"))
    # greatest() and least() skip nulls, so an absent track is tested for, not coalesced
    term = lambda name: F.when(track(name).isNotNull(), clipped_log(track(name))).otherwise(F.lit(0.0))
    prior = lambda name: F.lit(W_PRIOR) * F.coalesce(F.col(name), F.lit(0.0)) if name in frames.columns else F.lit(0.0)
    quiet = silence + F.lit(tuning.silence_bias)
    if tuning.high_recall:
        quiet = quiet + F.lit(HIGH_RECALL_SILENCE)
    scores = (
        quiet,
        speech + a + prior("prior_a"),
        speech + b + prior("prior_b"),
        speech + F.lit(W_OVERLAP) * (a + b) + F.lit(W_PROXY) * term("overlap_proxy") + F.lit(OVERLAP_BONUS),
        term("leak") + F.lit(LEAK_SILENCE) * silence + F.lit(LEAK_BASE),
    )
    return frames.select(*keep, *(s.alias(n) for s, n in zip(scores, SCORES)))


def incomplete(tracks: DataFrame) -> DataFrame:
    """Long table (rec, track, frame, ...) -> the recordings whose tracks do not all have the same frames."""
    per = distinct_frames(tracks, ["rec", "track"], F.max("frame").alias("last")).groupBy("rec", "track").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.max("last").alias("last"))
    return per.groupBy("rec").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("last").alias("last")).where("least != most or last + 1 != most")


def fuse_tracks(tracks: DataFrame, tuning: Tuning = Tuning(), names: tuple[str, ...] = ("vad", "diar_a", "diar_b", "leakage_likelihood", "leak", "overlap_proxy")) -> DataFrame:
    """Long table (rec, track, frame, value) -> fuse() of its wide form. Recordings whose tracks do not share a grid are an
    error, as are tables without tracks; the check is one aggregation, before anything else runs."""
    used = tracks.where(F.col("track").isin(*names))
    held = {r.track for r in used.select("track").distinct().collect()}  # at most as many as names
    if not held:
        raise ValueError("there are no tracks to fuse")
    if bad := incomplete(used).limit(3).collect():  # named in the message
        raise ValueError(f"tracks differ in frames: {', '.join(str(r.rec) for r in bad)}")
    return fuse(wide(used, tuple(n for n in names if n in held)), tuning)
