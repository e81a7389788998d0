"""Per-frame evidence from sample arrays: energies, stereo relations, diarization, overlap and the energy VAD.

Input frames have one row per (rec, frame) and arrays of samples ``left`` and ``right`` (or ``samples``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EPS = 1e-8


def by_rec():
    return W.partitionBy("rec").orderBy("frame")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def rms(samples: Column) -> Column:
    return F.sqrt(total(F.transform(samples, lambda x: x.cast("double") * x.cast("double"))) / F.size(samples))


def window_frames(smooth_ms: float, hop_s: float) -> int:
    return max(1, round(smooth_ms / (hop_s * 1000.0)))


def smooth(value: Column, width: int, over=None) -> Column:
    """Moving sum over width frames, centred, zeros beyond the ends, divided by width."""
    return F.sum(value).over((over or by_rec()).rowsBetween(-(width // 2), (width - 1) // 2)) / F.lit(float(width))


def slope(value: Column, hop_s: float, width: int = 2, tail: int = 2) -> list[tuple[str, Column]]:
    """Steps, as (name, column), that end in ``slope``: difference over the hop, smoothed, the last ``tail`` frames zero."""
    count = F.count("*").over(W.partitionBy("rec"))
    return [
        ("slope__raw", F.coalesce((value - F.lag(value).over(by_rec())) / F.lit(hop_s), F.lit(0.0))),
        ("slope__smooth", smooth(F.col("slope__raw"), width)),
        ("slope", F.when((count > tail) & (F.row_number().over(by_rec()) > count - tail), F.lit(0.0)).otherwise(F.col("slope__smooth"))),
    ]


def energies(frames: DataFrame) -> DataFrame:
    return frames.withColumn("energy_left", rms(F.col("left"))).withColumn("energy_right", rms(F.col("right")))


def log_ratio(left: Column, right: Column) -> Column:
    return F.log((left + F.lit(EPS)) / (right + F.lit(EPS)))


def correlation(left: Column, right: Column) -> Column:
    """Pearson correlation of two arrays; without variance 1 if they are close to equal, else 0; clipped."""
    n = F.size(left)
    centred = lambda a: F.transform(F.array(a), lambda v: F.transform(v, lambda x: x.cast("double") - total(F.transform(v, lambda y: y.cast("double"))) / n))[0]
    dot = lambda a, b: total(F.zip_with(a, b, lambda x, y: x * y))

    def value(p: Column) -> Column:
        a, b = p[0], p[1]
        scale = F.sqrt(dot(a, a) * dot(b, b))
        close = F.forall(F.zip_with(left, right, lambda x, y: F.abs(x.cast("double") - y.cast("double")) <= F.lit(1e-7) + F.lit(1e-5) * F.abs(y.cast("double"))), lambda ok: ok)
        return F.when(scale > EPS, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / scale))).when(close, F.lit(1.0)).otherwise(F.lit(0.0))

    return F.transform(F.array(F.array(centred(left), centred(right))), value)[0]


def stereo_evidence(frames: DataFrame) -> DataFrame:
    """energy_left, energy_right, log_ratio and correlation per frame."""
    return energies(frames).withColumn("log_ratio", log_ratio(F.col("energy_left"), F.col("energy_right"))).withColumn("correlation", correlation(F.col("left"), F.col("right")))


def channel_similarity(samples: DataFrame, threshold: float = 0.98) -> DataFrame:
    """samples(rec, l, r), one row a sample -> rec, correlation, label: "same" over the threshold, else "different".
    Without variance the correlation is 1 if both channels have none, else 0."""
    stats = samples.groupBy("rec").agg(F.covar_pop("l", "r").alias("c"), F.stddev_pop("l").alias("sl"), F.stddev_pop("r").alias("sr"))
    value = F.when((F.col("sl") > 1e-12) & (F.col("sr") > 1e-12), F.col("c") / F.nullif(F.col("sl") * F.col("sr"), F.lit(0.0))).when((F.col("sl") <= 1e-12) & (F.col("sr") <= 1e-12), F.lit(1.0)).otherwise(F.lit(0.0))
    return stats.select("rec", value.alias("correlation")).withColumn("label", F.when(F.col("correlation") > threshold, F.lit("same")).otherwise(F.lit("different")))


def diarization(energy: DataFrame) -> DataFrame:
    """Adds diar_a and diar_b from energy_left and energy_right by channel dominance."""
    dominance = (F.col("energy_left") - F.col("energy_right")) / (F.col("energy_left") + F.col("energy_right") + F.lit(EPS))
    clip = lambda c: F.greatest(F.lit(0.01), F.least(F.lit(0.99), c))
    return energy.withColumn("diar_a", clip(F.lit(0.5) + F.lit(0.49) * dominance)).withColumn("diar_b", clip(F.lit(0.5) - F.lit(0.49) * dominance))


def as_probability(value: Column, semantics: str) -> Column:
    if semantics == "probability":
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))
    if semantics == "logit":
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-value))
    raise ValueError(f"a probability or logit is needed, not {semantics}")


def overlap_proxy(a: Column, b: Column, semantics_a: str = "probability", semantics_b: str = "probability") -> Column:
    return as_probability(a, semantics_a) * as_probability(b, semantics_b)


#: fixed values of the energy detector: a narrower range of quantiles, or of all values, counts as none; above this it is speech
NARROW, FLAT, AUDIBLE = 1e-6, 1e-6, 1e-8


def energy_vad(frames: DataFrame, value: str = "energy") -> DataFrame:
    """Adds vad: the value scaled between its 10 and 90 percent quantiles (or its extremes), clipped, and blurred over nine
    frames with the end values repeated beyond the ends."""
    stats = frames.groupBy("rec").agg(F.percentile(value, F.array(F.lit(0.1), F.lit(0.9))).alias("q"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.count("*").alias("n"))
    narrow = (F.col("q")[1] - F.col("q")[0]) < NARROW
    stats = stats.select("rec", "n", F.when(narrow, F.col("lo")).otherwise(F.col("q")[0]).alias("floor"), F.when(narrow, F.col("hi")).otherwise(F.col("q")[1]).alias("ceiling"))
    flat = F.col("ceiling") - F.col("floor") < FLAT
    scaled = F.when(flat, F.when(F.col("ceiling") > AUDIBLE, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(value) - F.col("floor")) / F.when(flat, F.lit(1.0)).otherwise(F.col("ceiling") - F.col("floor"))))
    )
    p = frames.join(stats, "rec").withColumn("vad__p", scaled)
    whole = by_rec().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    p = p.withColumn("vad__i", F.row_number().over(by_rec()) - 1).withColumn("vad__first", F.first("vad__p").over(whole)).withColumn("vad__last", F.last("vad__p").over(whole))
    inside = F.sum("vad__p").over(by_rec().rowsBetween(-4, 4))
    before, after = F.greatest(F.lit(0), 4 - F.col("vad__i")), F.greatest(F.lit(0), F.col("vad__i") + 4 - (F.col("n") - 1))
    blurred = (inside + before * F.col("vad__first") + after * F.col("vad__last")) / F.lit(9.0)
    return p.withColumn("vad", F.when(F.col("n") > 1, blurred).otherwise(F.col("vad__p"))).drop("vad__p", "vad__i", "vad__first", "vad__last", "n", "floor", "ceiling")


def frames_of(samples: DataFrame, rate: int, hop_s: float) -> DataFrame:
    """samples(rec, channel, sample, value) -> rec, channel, frame, samples: whole frames only, in sample order."""
    hop = round(rate * hop_s)
    if hop < 1:
        raise ValueError("the hop is shorter than a sample")
    cut = samples.groupBy("rec", "channel", F.floor(F.col("sample") / hop).alias("frame")).agg(F.array_sort(F.collect_list(F.struct("sample", "value"))).alias("s"))  # hop rows a group
    return cut.where(F.size("s") == hop).select("rec", "channel", "frame", F.col("s.value").alias("samples"))
