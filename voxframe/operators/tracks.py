"""Tracks as long tables: validation, selection by alias, merging of bundles, and the wide frame table.

tracks(rec, track, semantics, hop_s, n_frames, k); track_frames(rec, track, frame, k, value, confidence).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.operators.spread import distinct_frames

SEMANTICS = ("probability", "logit", "score")
SLACK = 1e-3
#: Fixed values, as track files use these names: which tracks can stand for a name; the first that a recording has is taken.
ALIASES = {
    "energy": ("energy", "energy_smooth", "energy_rms"),
    "vad": ("vad", "vad_soft"),
    "voicing": ("voicing", "voiced_soft"),
    "speaker_a": ("speaker_a", "diar_a"),
    "speaker_b": ("speaker_b", "diar_b"),
    "overlap": ("overlap", "overlap_proxy"),
}


def violations(frames: DataFrame, tracks: DataFrame) -> DataFrame:
    """rec, track, problem, n: what is wrong with tracks; no rows if nothing is. One pass over the frames."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    value, conf = F.col("value"), F.col("confidence")
    outside = lambda c: (c < -SLACK) | (c > 1 + SLACK)
    counts = {
        "not_finite": F.count_if(F.col("frame").isNotNull() & bad(value)),
        "out": F.count_if(F.col("frame").isNotNull() & outside(value)),
        "confidence_range": F.count_if(conf.isNotNull() & (F.isnan(conf) | outside(conf))),
    }
    # the frames are summed before they meet their tracks, by stretches and then by track
    held = distinct_frames(frames, ["rec", "track"], *(c.alias(name) for name, c in counts.items()))
    summed = held.groupBy("rec", "track").agg(*(F.sum(c).alias(c) for c in counts), F.sum("n").alias("seen"))
    each = tracks.groupBy("rec", "track", "semantics", "hop_s", "n_frames").agg(F.count("*").alias("copies")).join(summed, ["rec", "track"], "left")
    found = lambda c: F.coalesce(F.col(c), F.lit(0)) * F.col("copies")
    per = each.select(
        "rec", "track", "semantics", "hop_s", "n_frames",
        found("not_finite").alias("not_finite"),
        F.when(F.col("semantics") == "probability", found("out")).otherwise(F.lit(0)).alias("probability_range"),
        found("confidence_range").alias("confidence_range"),
        F.coalesce("seen", F.lit(0)).alias("seen"),
    )
    base = per.groupBy("rec").agg(F.min("hop_s").alias("low"), F.max("hop_s").alias("high"))
    checked = per.join(base, "rec").withColumns({
        "semantics_unknown": (~F.col("semantics").isin(*SEMANTICS)).cast("long"),
        "empty": (F.col("seen") == 0).cast("long"),
        "length": F.when(F.col("n_frames").isNotNull() & (F.col("seen") != F.col("n_frames")), F.abs(F.col("seen") - F.col("n_frames"))).otherwise(F.lit(0)),
        "hop_mixed": (F.col("high") - F.col("low") > 1e-12).cast("long"),
    })
    names = ["not_finite", "probability_range", "confidence_range", "semantics_unknown", "empty", "length", "hop_mixed"]
    return checked.select("rec", "track", F.explode(F.array(*[F.struct(F.lit(n).alias("problem"), F.col(n).cast("long").alias("n")) for n in names])).alias("v")).select("rec", "track", "v.*").where("n > 0")


def merge_bundles(base: DataFrame, override: DataFrame) -> DataFrame:
    """All tracks of both; where a recording's track is in both, that of override."""
    # by rec alone, in which tables of frames are dealt already, and with the tracks of override, few a recording, as the table
    # that is held: base is neither dealt again nor sorted
    taken = override.groupBy(F.col("rec").alias("tr__rec")).agg(F.collect_set("track").alias("tr__tracks")).hint("shuffle_hash")
    return override.unionByName(base.join(taken, (F.col("rec") == F.col("tr__rec")) & F.array_contains("tr__tracks", F.col("track")), "left_anti"))


def by_alias(frames: DataFrame, aliases: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """The frames under the names of aliases; of several tracks for a name the first that the recording has."""
    rows = [(name, track, k) for name, tracks in (aliases or ALIASES).items() for k, track in enumerate(tracks)]
    table = F.broadcast(frames.sparkSession.createDataFrame(rows, "name string, track string, place int"))  # a fixed list
    present = frames.select("rec", "track").distinct().join(table, "track").groupBy("rec", "name").agg(F.min_by("track", "place").alias("track"))
    return frames.join(present, ["rec", "track"])


def wide(frames: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """One row per rec and frame, one column per track; a track that is absent is null."""
    return frames.where(F.col("track").isin(*names)).groupBy("rec", "frame").agg(*(F.max(F.when(F.col("track") == n, F.col("value"))).alias(n) for n in names))
