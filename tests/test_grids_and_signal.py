import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe.operators import resample, signal, spectral
from voxframe.operators.timebase import TimeBase


def series(spark, values, rec=1):
    return spark.createDataFrame([(rec, i, float(v)) for i, v in enumerate(values)], "rec long, frame long, value double")


def values(df, c="value"):
    return [r[c] for r in df.orderBy("rec", "frame").collect()]


def test_time_mapping():
    t = TimeBase()
    assert t.is_canonical and t.hop_ms == 10
    assert t.time_to_frame(0.025) == 2 and t.num_frames(0.07) == math.ceil(0.07 / 0.01) and t.frame_to_time(3) == 3 * 0.01
    for bad in (lambda: t.frame_to_time(-1), lambda: t.time_to_frame(-0.1), lambda: t.num_frames(-1), lambda: TimeBase(0.0), lambda: TimeBase(0.02).require_canonical()):
        with pytest.raises(ValueError):
            bad()


def test_upsample_and_downsample(spark):
    assert values(resample.resample(series(spark, [1, 2, 3]), TimeBase(0.02), TimeBase(0.01), {"value": None})) == [1, 1, 2, 2, 3, 3]
    assert values(resample.resample(series(spark, [1, 3, 5, 7]), TimeBase(0.01), TimeBase(0.02), {"value": "mean"})) == [2, 6]
    assert values(resample.to_canonical(series(spark, [1, 2, 3, 4]), TimeBase(0.005), {"value": "max"})) == [2, 4]
    with pytest.raises(ValueError):
        resample.to_canonical(series(spark, [1, 2]), TimeBase(0.005), {"value": None})
    with pytest.raises(ValueError):
        resample.factor(0.015, 0.01)
    with pytest.raises(Exception, match="multiple"):
        resample.downsample(series(spark, [1] * 5), 3, {"value": "mean"}).collect()


def test_smoothing_is_zero_padded(spark):
    x = [0, 0, 1, 1, 1, 0, 2, 5, 1]
    for w in (1, 2, 3, 8):
        got = values(series(spark, x).select("rec", "frame", signal.smooth(F.col("value"), w).alias("value")))
        want = np.convolve(x, np.ones(w) / w, mode="same")[: len(x)] if w <= len(x) else None
        assert np.allclose(got, want)


def test_slope_tail_is_zero(spark):
    df = series(spark, [0, 0, 1, 1, 1, 1])
    for n, c in signal.slope(F.col("value"), 0.01):
        df = df.withColumn(n, c)
    got = values(df, "slope")
    assert max(got) > 0.05 and got[-2:] == [0, 0]


def stereo(spark, pairs, rec=1):
    return spark.createDataFrame([(rec, i, [float(v) for v in a], [float(v) for v in b]) for i, (a, b) in enumerate(pairs)], "rec long, frame long, left array<double>, right array<double>")


def test_stereo_evidence(spark):
    t = np.sin(np.arange(64))
    out = signal.stereo_evidence(stereo(spark, [(t, t), (t * 0.8, t * 0.2), (np.zeros(64), np.zeros(64)), (np.ones(64), np.zeros(64))])).orderBy("frame").collect()
    assert abs(out[0].log_ratio) < 1e-9 and abs(out[0].correlation - 1) < 1e-9
    assert out[1].log_ratio > 0
    assert out[2].correlation == 1 and out[3].correlation == 0


def test_channel_similarity(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=500), rng.normal(size=500)
    rows = [(1, x, x / 2) for x in a.tolist()] + [(2, x, y) for x, y in zip(a.tolist(), b.tolist())] + [(3, 0.0, 0.0)] * 9
    got = {r.rec: r for r in signal.channel_similarity(spark.createDataFrame(rows, "rec long, l double, r double")).collect()}
    assert got[1].label == "same" and got[2].label == "different" and got[3].correlation == 1


def test_overlap_proxy(spark):
    df = spark.createDataFrame([(0.2, 0.5), (0.5, 0.5), (1.0, 0.25)], "a double, b double")
    assert [r[0] for r in df.select(signal.overlap_proxy(F.col("a"), F.col("b"))).collect()] == [0.1, 0.25, 0.25]
    with pytest.raises(ValueError):
        signal.overlap_proxy(F.col("a"), F.col("b"), "score")


def test_energy_vad(spark):
    got = values(signal.energy_vad(series(spark, [0.0] * 30 + [0.04] * 30 + [0.0] * 30), "value"), "vad")
    assert min(got) >= 0 and max(got) <= 1 and max(got) > min(got)
    p = np.clip(np.array([0.0] * 30 + [0.04] * 30 + [0.0] * 30) / 0.04, 0, 1)
    assert np.allclose(got, np.convolve(np.pad(p, 4, mode="edge"), np.ones(9) / 9, mode="valid"))
    assert values(signal.energy_vad(series(spark, [0.3] * 5), "value"), "vad") == pytest.approx([1.0] * 5)
    assert values(signal.energy_vad(series(spark, [0.0]), "value"), "vad") == [0.0]


def test_leakage_separates_echo_from_other_speech(spark):
    t = np.arange(160) / 16000
    echo = [(np.sin(2 * np.pi * 200 * (t + i * 0.01)) * 0.8, np.sin(2 * np.pi * 200 * (t + i * 0.01)) * 0.2) for i in range(20)]
    other = [(np.sin(2 * np.pi * 200 * t) * 0.6, np.sin(2 * np.pi * 900 * t) * 0.6) for _ in range(20)]
    mean = lambda f: np.mean(values(spectral.leakage(f, 400), "leakage"))
    assert mean(stereo(spark, echo)) > 0.2 and mean(stereo(spark, other)) < 0.1


def test_interpolation_matches_numpy(spark):
    x = [0.0, 1.0, 4.0, 9.0]
    df = spark.createDataFrame([(x,)], "x array<double>")
    for n in (1, 3, 4, 9):
        got = df.select(resample.interpolate(F.col("x"), n)).first()[0]
        assert np.allclose(got, np.interp(np.linspace(0, 3, n), range(4), x))
