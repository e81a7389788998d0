"""Leakage evidence: channel dominance times the likeness of pooled log spectra, gated by energy. The spectra need an FFT,
which SQL lacks, so those of many frames at a time go through one Arrow UDF."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from voxframe.operators.signal import EPS, by_rec, energies

BINS = 64


def pooled_log_spectrum(frames: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Rows of samples -> rows of log1p of mean power in ``bins`` ranges of frequencies, as equal as can be."""
    power = np.abs(np.fft.rfft(frames * np.hanning(frames.shape[1]), axis=1)) ** 2
    n = power.shape[1]
    if n < bins:
        pooled = np.pad(power, ((0, 0), (0, bins - n)))
    else:
        size = np.full(bins, n // bins)
        size[: n % bins] += 1
        pooled = np.add.reduceat(power, np.concatenate([[0], np.cumsum(size)[:-1]]), axis=1) / size
    return np.log1p(pooled)


@F.pandas_udf(DoubleType())
def spectral_likeness(left: pd.Series, right: pd.Series) -> pd.Series:
    """Cosine of the pooled spectra of two arrays, clipped to 0..1. Arrays of a batch may differ in length."""
    out = np.zeros(len(left))
    sizes = np.array([len(x) for x in left])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        a, b = (pooled_log_spectrum(np.stack([np.asarray(s.iloc[k], dtype=float) for k in at])) for s in (left, right))
        cosine = (a * b).sum(1) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1) + EPS)
        out[at] = np.clip(cosine, 0, 1)
    return pd.Series(out)


def centred_window(samples: Column, before: Column, after: Column, width: int | Column) -> Column:
    """``width`` samples around the middle of a frame, from it and its neighbours (null: zeros)."""
    size = F.size(samples)
    count = F.lit(width) if isinstance(width, int) else width
    zeros = F.array_repeat(F.lit(0.0), size)
    joined = F.concat(F.coalesce(before, zeros), samples, F.coalesce(after, zeros))
    return F.slice(joined, (size + F.floor(size / 2) - F.floor(count / 2) + 1).cast("int"), count.cast("int"))


def gate(energy: DataFrame) -> DataFrame:
    """Adds dominance (strength) and gate (total energy over its 90 percent quantile) from energy_left and energy_right."""
    both = F.col("energy_left") + F.col("energy_right")
    reference = energy.withColumn("gate__t", both).groupBy("rec").agg(F.percentile("gate__t", 0.9).alias("gate__ref"))
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return energy.join(reference, "rec").withColumn("dominance", clip(F.abs((F.col("energy_left") - F.col("energy_right")) / (both + F.lit(EPS))))).withColumn("gate", clip(both / (F.col("gate__ref") + F.lit(EPS)))).drop("gate__ref")


def leakage(frames: DataFrame, window_samples: int | Column | None = None) -> DataFrame:
    """frames(rec, frame, left, right) -> and leakage in 0..1. window_samples, at most three frames, defaults to one frame."""
    if window_samples is not None:
        for side in ("left", "right"):
            frames = frames.withColumn(f"{side}__w", centred_window(F.col(side), F.lag(side).over(by_rec()), F.lead(side).over(by_rec()), window_samples))
    pair = ("left__w", "right__w") if window_samples is not None else ("left", "right")
    seen = frames.withColumn("likeness", spectral_likeness(*pair))
    out = gate(energies(seen))
    return out.withColumn("leakage", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("dominance") * F.col("likeness") * F.col("gate")))).drop("left__w", "right__w")
