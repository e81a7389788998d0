"""Uniform frame grids: conversions between seconds and frame indices, as columns and as plain numbers."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOP_S, HOP_TOLERANCE = 0.01, 1e-12


@dataclass(frozen=True)
class TimeBase:
    hop_s: float = HOP_S
    n_frames: int | None = None

    def __post_init__(self):
        if not self.hop_s > 0:
            raise ValueError(f"hop_s must be positive, not {self.hop_s}")
        if self.n_frames is not None and self.n_frames < 0:
            raise ValueError(f"n_frames must not be negative: {self.n_frames}")
        if abs(self.hop_s - HOP_S) <= HOP_TOLERANCE:
            object.__setattr__(self, "hop_s", HOP_S)

    @property
    def hop_ms(self) -> float:
        return self.hop_s * 1000.0

    @property
    def is_canonical(self) -> bool:
        return self.hop_s == HOP_S

    def require_canonical(self) -> None:
        if not self.is_canonical:
            raise ValueError(f"a hop of {HOP_S} s is needed, not {self.hop_s}")

    def frame_to_time(self, frame: int) -> float:
        if frame < 0:
            raise ValueError("frame must not be negative")
        return frame * self.hop_s

    def time_to_frame(self, seconds: float) -> int:
        if seconds < 0:
            raise ValueError("time must not be negative")
        return math.floor(seconds / self.hop_s)

    def num_frames(self, seconds: float) -> int:
        if seconds < 0:
            raise ValueError("duration must not be negative")
        return math.ceil(seconds / self.hop_s)

    def frame_times(self, spark: SparkSession, n: int | None = None) -> DataFrame:
        count = self.n_frames if n is None else n
        if count is None or count < 0:
            raise ValueError("the number of frames is needed")
        return spark.range(count).select(F.col("id").alias("frame"), frame_time(F.col("id"), self.hop_s).alias("time_s"))


def frame_time(frame: Column, hop_s: float = HOP_S) -> Column:
    return frame.cast("double") * F.lit(hop_s)


def time_frame(seconds: Column, hop_s: float = HOP_S) -> Column:
    return F.floor(seconds / F.lit(hop_s))


def frame_count(seconds: Column, hop_s: float = HOP_S) -> Column:
    return F.ceil(seconds / F.lit(hop_s))
