import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe.operators import decode as dec
from voxframe.operators import fusion, segments
from voxframe.sources import audio


def scores(spark, rows, rec=1):
    return spark.createDataFrame([(rec, i, *map(float, r)) for i, r in enumerate(rows)], "rec long, frame long, s_sil double, s_a double, s_b double, s_ovl double, s_leak double")


def path(df):
    return [r.state for r in df.orderBy("rec", "frame").collect()]


def collapsed(p):
    return [k for k, _ in itertools.groupby(p)]


def brute(rows, m):
    """The path by trying each predecessor at each frame, state by state."""
    n = len(m.base)
    best, back = [m.first[j] + rows[0][m.base[j]] for j in range(n)], []
    for r in rows[1:]:
        come = [max(range(n), key=lambda i: (best[i] + m.step[i, j], -i)) for j in range(n)]
        best, back = [best[come[j]] + m.step[come[j], j] + r[m.base[j]] for j in range(n)], [*back, come]
    j = max(range(n), key=lambda i: (best[i], -i))
    out = [j]
    for come in reversed(back):
        out.append(j := come[j])
    return [dec.STATES[m.base[j]] for j in reversed(out)]


def test_default_penalties():
    p = dec.penalties()
    assert [p["SIL", s] for s in dec.STATES] == [0, -4, -4, -4, -np.inf]
    assert [p["A", s] for s in dec.STATES] == [-3.5, 0, -6, -3, -2]
    assert [p["LEAK", s] for s in dec.STATES] == [-1, -np.inf, -np.inf, -5, 0]
    assert dec.penalties(dec.Tuning(high_recall=True))["A", "SIL"] == -10.5
    assert len(dec.model().base) == 14


@pytest.mark.parametrize("seed", range(4))
def test_viterbi_equals_brute_force_with_ties(seed):
    rng = np.random.default_rng(seed)
    m = dec.model()
    many = [np.round(rng.normal(size=(n, 5)) * 2) / 2 for n in (1, 2, 7, 30, 30, 45)]
    for got, rows in zip(dec.viterbi(many, m), many):
        assert [dec.STATES[k] for k in got] == brute(rows.tolist(), m)


def test_scripted_blocks(spark):
    high = lambda k, n: [[6.0 if i == k else 0.0 for i in range(5)]] * n
    got = path(dec.decode(scores(spark, high(1, 4) + high(0, 3) + high(2, 4)), least={"SIL": 1, "A": 1, "B": 1, "OVL": 1, "LEAK": 1}))
    assert collapsed(got) == ["A", "SIL", "B"]


def test_batches_do_not_split_recordings(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(rec, i, *rng.normal(size=5).tolist()) for rec in range(12) for i in range(40)]
    df = spark.createDataFrame(rows, "rec long, frame long, s_sil double, s_a double, s_b double, s_ovl double, s_leak double")
    one = path(dec.decode(df))
    monkeypatch.setattr(dec, "BATCH_FRAMES", 50)
    assert path(dec.decode(df)) == one
    by_rec = [np.array([r[2:] for r in rows if r[0] == k]) for k in range(12)]
    assert one == [dec.STATES[s] for p in dec.viterbi(by_rec, dec.model()) for s in p]


def frames(spark, blocks, on=(0.95, 0.05), spk=(0.9, 0.1)):
    track = lambda name, inside, hi, lo: audio.block_track(spark, "r", blocks, inside, hi, lo).withColumnRenamed("value", name)
    out = track("vad", ("A", "B", "OVL"), *on).join(track("diar_a", ("A", "OVL"), *spk), ["rec", "frame"]).join(track("diar_b", ("B", "OVL"), *spk), ["rec", "frame"])
    return out.withColumn("leak", F.lit(0.05))


def test_scripted_tracks_decode_to_their_labels(spark):
    blocks = [("SIL", 100), ("A", 150), ("SIL", 50), ("B", 100), ("OVL", 80), ("SIL", 70)]
    got, at = path(dec.decode(fusion.fuse(frames(spark, blocks)))), 0
    for label, n in blocks:
        assert got[at + n // 2] == label
        at += n


def test_missing_tracks_and_ties(spark):
    f = frames(spark, [("SIL", 80), ("A", 120), ("SIL", 80)]).select("rec", "frame", "vad")
    assert collapsed(path(dec.decode(fusion.fuse(f)))) == ["SIL", "A", "SIL"]


def test_leak_rules(spark):
    rng = np.random.default_rng(0)
    got = path(dec.decode(scores(spark, rng.normal(size=(400, 5)) * 3 + [0, 0, 0, 0, 2])))
    pairs = set(zip(got, got[1:]))
    assert got[0] != "LEAK" and ("SIL", "LEAK") not in pairs and not pairs & {("LEAK", "A"), ("LEAK", "B")} and "LEAK" in got
    runs = [(k, len(list(g))) for k, g in itertools.groupby(got)]
    assert all(n >= (2 if k == "SIL" else 3) for k, n in runs[:-1])


def test_high_recall_has_fewer_silences(spark):
    vad = [0.05] * 10 + [0.7] * 20 + [0.2] * 3 + [0.7] * 17 + [0.2] * 3 + [0.7] * 17 + [0.05] * 10
    f = spark.createDataFrame([("r", i, v) for i, v in enumerate(vad)], "rec string, frame long, vad double")
    count = lambda t: collapsed(path(dec.decode(fusion.fuse(f, t), t))[10:70]).count("SIL")
    assert count(dec.Tuning(high_recall=True)) < count(dec.Tuning())


def test_counters_and_incomplete(spark):
    s = spark.createDataFrame([(1, i, x) for i, x in enumerate("SIL LEAK LEAK A A SIL LEAK OVL SIL".split())], "rec long, frame long, state string")
    assert dec.counters(s).first().ipu_start_after_leak == 2
    t = spark.createDataFrame([(1, "vad", i) for i in range(30)] + [(1, "diar_a", i) for i in range(20)] + [(2, "vad", 0)], "rec long, track string, frame long")
    assert [r.rec for r in fusion.incomplete(t).collect()] == [1]


def test_quiet_dips_merge_into_one(spark):
    vad = [0.05] * 10 + [0.52] * 70 + [0.05] * 10
    for k in (*range(30, 33), *range(55, 58)):
        vad[k] = 0.38
    f = spark.createDataFrame([("r", i, v, 0.92, 0.05) for i, v in enumerate(vad)], "rec string, frame long, vad double, diar_a double, diar_b double")
    t = dec.Tuning(high_recall=True, silence_bias=-0.25)
    found = segments.merge_per_label(segments.ipus(dec.decode(fusion.fuse(f, t), t)), 0.4).where("label = 'A'").collect()
    assert len(found) == 1 and found[0].start_time <= 0.1 + 1e-9 and found[0].end_time >= 0.8 - 1e-9
