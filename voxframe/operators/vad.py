"""Voice activity: the WebRTC detector where that library is installed, else the energy detector."""

from __future__ import annotations

import importlib.util
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.operators import signal

RATE, BLUR = 16_000, 9


def sixteen_bit(samples: np.ndarray, n: int) -> bytes:
    """The samples resampled linearly to n values, as 16-bit PCM."""
    x = np.asarray(samples, dtype=float)
    if len(x) != n:
        x = np.interp(np.linspace(0, len(x) - 1, n), np.arange(len(x)), x)
    return (np.clip(x, -1, 1) * 32767).astype("<i2").tobytes()


def installed() -> bool:
    return importlib.util.find_spec("webrtcvad") is not None


def soft_vad(frames: DataFrame, mode: int = 2, hop_s: float = 0.01, smooth_ms: float = 80.0) -> DataFrame:
    """frames(rec, frame, samples) of hop_s seconds each -> rec, frame, vad in 0..1. The detector's votes are blurred over
    nine frames, with zeros beyond the ends; the energy detector repeats the end values."""
    if not installed():
        energy = frames.select("rec", "frame", signal.rms(F.col("samples")).alias("energy"))
        energy = energy.withColumn("energy", signal.smooth(F.col("energy"), signal.window_frames(smooth_ms, hop_s)))
        return signal.energy_vad(energy).select("rec", "frame", "vad")
    rec = frames.schema["rec"].dataType.simpleString()

    def votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import webrtcvad

        detector = webrtcvad.Vad(mode)
        for batch in batches:
            yield pd.DataFrame({"rec": batch["rec"], "frame": batch["frame"], "vote": [float(detector.is_speech(sixteen_bit(s, round(RATE * hop_s)), RATE)) for s in batch["samples"]]})

    voted = frames.select("rec", "frame", "samples").mapInPandas(votes, f"rec {rec}, frame long, vote double")
    return voted.select("rec", "frame", signal.smooth(F.col("vote"), BLUR).alias("vad"))
