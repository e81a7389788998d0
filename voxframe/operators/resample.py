"""Resampling of frame tables between grids whose hops divide each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.operators.timebase import HOP_S, TimeBase

AGGREGATES = {"mean": F.avg, "max": F.max}


def factor(coarse: float, fine: float) -> int:
    """How many fine frames make a coarse one; the ratio must be whole."""
    ratio = coarse / fine
    if round(ratio) < 1 or abs(ratio - round(ratio)) > 1e-12 * max(1.0, ratio):
        raise ValueError(f"hops {coarse} and {fine} are not in a whole ratio")
    return round(ratio)


def upsample_hold(frames: DataFrame, times: int) -> DataFrame:
    """Each frame repeated ``times`` times; other columns held."""
    steps = F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("rs__step")
    return frames.select("*", steps).withColumn("frame", F.col("frame") * times + F.col("rs__step")).drop("rs__step")


def downsample(frames: DataFrame, times: int, values: dict[str, str], keys: tuple[str, ...] = ("rec",), check: bool = True) -> DataFrame:
    """Blocks of ``times`` frames by the aggregate ("mean" or "max") named for each value column. With check, a block that
    is not full, which means a length that ``times`` does not divide, raises an error as the query runs."""
    aggregates = [AGGREGATES[how](c).alias(c) for c, how in values.items()]
    out = frames.groupBy(*keys, F.floor(F.col("frame") / times).alias("frame")).agg(*aggregates, F.count("*").alias("rs__n"))
    if check:
        full = F.when(F.col("rs__n") == times, F.lit(True)).otherwise(F.raise_error(F.lit(f"the number of frames is not a multiple of {times}")).cast("boolean"))
        out = out.where(full)
    return out.drop("rs__n")


def resample(frames: DataFrame, source: TimeBase, target: TimeBase, values: dict[str, str | None], keys: tuple[str, ...] = ("rec",)) -> DataFrame:
    """Holds when the target is finer, aggregates when it is coarser; a coarser target needs an aggregate per column."""
    if abs(source.hop_s - target.hop_s) <= 1e-12:
        return frames
    if source.hop_s > target.hop_s:
        return upsample_hold(frames, factor(source.hop_s, target.hop_s))
    if any(how not in AGGREGATES for how in values.values()):
        raise ValueError('an aggregate, "mean" or "max", is needed to go to a coarser grid')
    return downsample(frames, factor(target.hop_s, source.hop_s), values, keys)


def to_canonical(frames: DataFrame, source: TimeBase, values: dict[str, str | None], keys: tuple[str, ...] = ("rec",)) -> DataFrame:
    return resample(frames, source, TimeBase(HOP_S), values, keys)


def resample_all(tracks: DataFrame, times: int, how: Column) -> DataFrame:
    """Long table (rec, track, frame, k, value, confidence) to a grid ``times`` coarser; ``how`` gives "mean" or "max" by
    row, from the track's name. Values and confidences use the same aggregate."""
    # a boolean, unlike a name, leaves the groups in a hash table; a sort would take all rows
    pick = lambda c: F.when(F.first("rs__max"), F.max(c)).otherwise(F.avg(c)).alias(c)
    return tracks.withColumn("rs__max", how == "max").groupBy("rec", "track", F.floor(F.col("frame") / times).alias("frame"), "k").agg(pick("value"), pick("confidence"))


def interpolate(samples: Column, n: int | Column) -> Column:
    """An array resampled linearly to n values over its whole length."""
    size = F.size(samples)
    count = F.lit(n) if isinstance(n, int) else n
    at = lambda j: j.cast("double") * F.greatest(size - 1, F.lit(0)) / F.greatest(count - 1, F.lit(1))

    def value(j: Column) -> Column:
        low = F.floor(at(j)).cast("int")
        a, b = F.get(samples, low), F.coalesce(F.get(samples, low + 1), F.get(samples, low))
        return a + (b - a) * (at(j) - low)

    return F.transform(F.sequence(F.lit(0), count - 1), value)


def cut(samples: Column, rate: Column, start_s: Column, end_s: Column) -> Column:
    """The samples between two times, rounded to whole samples, clamped to the array."""
    size = F.size(samples)
    a = F.greatest(F.lit(0), F.least(size, F.bround(start_s * rate).cast("int")))
    b = F.greatest(a, F.least(size, F.bround(end_s * rate).cast("int")))
    return F.slice(samples, a + 1, b - a)
