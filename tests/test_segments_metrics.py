import itertools

import numpy as np
import pytest

from voxframe.operators import chunking, evaluation, metrics, segments, textgrid, tracks, transcript


def states(spark, *paths):
    return spark.createDataFrame([(r, i, s) for r, p in enumerate(paths) for i, s in enumerate(p.split())], "rec long, frame long, state string")


def segs(spark, rows):
    return spark.createDataFrame(rows, "rec long, label string, start_time double, end_time double")


def test_runs_and_ipus(spark):
    got = segments.ipus(states(spark, "SIL A A A SIL B B"), 0.02).orderBy("start_time").collect()
    assert [(r.label, round(r.start_time, 3), round(r.end_time, 3)) for r in got] == [("A", 0.01, 0.04), ("B", 0.05, 0.07)]


def test_merge_gaps_is_strict(spark):
    got = segments.merge_gaps(segs(spark, [(1, "A", 0.0, 0.5), (1, "A", 0.7, 1.1), (1, "A", 1.7, 2.0)]), 0.4).orderBy("start_time").collect()
    assert [(r.start_time, r.end_time) for r in got] == [(0.0, 1.1), (1.7, 2.0)]
    assert segments.merge_gaps(segs(spark, [(1, "A", 0.0, 0.5), (1, "A", 0.75, 1.0)]), 0.25).count() == 2


def test_rasterize_order_of_paint(spark):
    lens = spark.createDataFrame([(1, 6), (2, 2)], "rec long, n_frames long")
    got = segments.rasterize(segs(spark, [(1, "A", 0.0, 0.03), (1, "LEAK", 0.02, 0.05), (1, "OVL", 0.04, 0.2), (1, "B", 0.0, 0.02)]), lens, block=2).orderBy("rec", "frame").collect()
    assert [r.state for r in got] == ["A", "A", "LEAK", "LEAK", "OVL", "OVL", "SIL", "SIL"]


def test_boundary_scores(spark):
    times = lambda xs: spark.createDataFrame([(1, x) for x in xs], "rec long, time_s double")
    recs = spark.createDataFrame([(1,), (2,)], "rec long")
    got = {r.rec: r for r in metrics.boundary_scores(times([0.1, 0.5]), times([0.11, 0.7]), 0.05, recs).collect()}
    assert (got[1].tp, got[1].fp, got[1].fn) == (1, 1, 1) and got[2].f1 == 0


@pytest.mark.parametrize("seed", range(5))
def test_matching_equals_plain_loop(seed):
    rng = np.random.default_rng(seed)
    ref, hyp = np.round(rng.uniform(0, 3, 40), 2), np.round(rng.uniform(0, 3, 40), 2)
    used, hits, r = set(), 0, np.sort(ref)
    for h in np.sort(hyp):
        near = [i for i in range(len(r)) if abs(r[i] - h) <= 0.05 and i not in used]
        if near:
            used.add(min(near, key=lambda i: abs(r[i] - h)))
            hits += 1
    assert metrics.matched(ref, hyp, 0.05) == hits


def test_other_metrics(spark):
    s = states(spark, "SIL SIL SIL", "A A B", "A B A SIL")
    assert [r.iou_a for r in metrics.framewise(s, states(spark, "SIL SIL SIL", "SIL SIL B", "A B A SIL")).orderBy("rec").collect()] == [1.0, 0.0, 1.0]
    assert [r.rapid_alternations for r in metrics.rapid_alternations(s).orderBy("rec").collect()] == [0, 0, 1]
    assert metrics.speaker_switches(states(spark, "SIL A A B B A A")).first().switches_per_min > 0
    one = spark.createDataFrame([(1, 60.0), (2, 0.0)], "rec long, total_s double")
    assert [r[1] for r in metrics.micro_ipus(segs(spark, [(1, "A", 0.0, 0.1), (1, "A", 0.5, 0.9)]), one).orderBy("rec").collect()] == [1.0, 0.0]


def test_chunks():
    assert [c[2] for c in chunking.chunks([(0, 0.7), (0.8, 1.4), (1.5, 2.5)], 3)] == [[0, 1, 2]]
    long_ = chunking.chunks([(0.0, 22.0)], 22.0)
    assert len(long_) >= 2 and all(e - s <= 18 for s, e, _ in long_) and all(i == [0] for *_, i in long_)
    assert all(2 <= e - s <= 18 for s, e, _ in chunking.chunks([(0, 3), (4, 7), (8, 11.5), (12, 16), (17, 20)], 20))
    assert chunking.chunks([], 1) == [] and chunking.chunks([(0, 0.2)], 1) == []
    with pytest.raises(ValueError):
        chunking.chunks([(0, 1)], -1)


def test_words_on_segments(spark):
    words = spark.createDataFrame([(1, "a", 0.0, 0.4, None), (1, "a", 0.0002, 0.4001, None), (1, "b", 0.45, 0.6, None), (1, "c", 30.0, 31.0, None)], "rec long, word string, start_time double, end_time double, speaker string")
    ipus = spark.createDataFrame([(1, 0, "A", 0.0, 0.5), (1, 1, "B", 0.5, 25.0), (1, 2, "A", 26.0, 29.0)], "rec long, ipu long, label string, start_time double, end_time double")
    assert transcript.deduplicate(words).count() == 3
    got = {r.ipu: (r.text, r.n_words) for r in transcript.align(words, ipus).collect()}
    assert got == {0: ("a b", 2), 1: ("b", 1)}


def test_backend_runs_per_task_and_results_are_in_recording_time(spark):
    chunks = spark.createDataFrame([(1, 10.0, 12.0), (1, 0.0, 2.0)], "rec long, start_time double, end_time double")
    got = transcript.transcribe(chunks, lambda: lambda c: [(0.0, 0.5, " hello "), (0.0, 0.5, "hello"), (1.9, 9.0, "end"), (3.0, 2.0, "gone"), (0.1, 0.2, " ")]).orderBy("start_time", "text").collect()
    assert [(r.start_time, r.end_time, r.text) for r in got] == [(0.0, 0.5, "hello"), (1.9, 2.0, "end"), (10.0, 10.5, "hello"), (11.9, 12.0, "end")]


def test_textgrid_round_trip(spark):
    rows = [(1, "SpeakerA", 0.25, 0.5, "A"), (1, "SpeakerB", 0.5, 1.0, "B")]
    df = spark.createDataFrame(rows, "rec long, tier string, start_time double, end_time double, label string")
    doc = textgrid.render(df)
    text = doc.first().document
    assert 'text = "#"' in text and "size = 4" in text and "xmax = 1\n" in text
    assert sorted(map(tuple, textgrid.parse(doc).collect())) == sorted(rows)


def test_gap_fill_with_clipping(spark):
    df = segs(spark, [(1, "x", 1.0, 5.0), (1, "y", 2.0, 3.0), (1, "z", 4.0, 6.0)])
    got = segments.fill_gaps(df, clip=True, label="").orderBy("start_time").collect()
    assert [(r.label, r.start_time, r.end_time) for r in got] == [("", 0.0, 1.0), ("x", 1.0, 5.0), ("z", 5.0, 6.0)]


def card(spark, rows):
    return spark.createDataFrame(rows, "id string, tier string, status string, boundary_f1_20ms double, boundary_f1_50ms double, micro_ipus_per_min double, switches_per_min double")


def test_guardrails(spark):
    base = card(spark, [("e", "easy", "ok", 0.8, 0.9, 2.0, 4.0), ("h", "hard", "ok", 0.5, 0.5, 1.0, 1.0), ("x", "easy", "failed", 0.0, 0.0, 0.0, 0.0)])
    same = evaluation.findings(evaluation.deltas(base, base), params_changed=False)
    assert same.count() == 0
    worse = card(spark, [("e", "easy", "ok", 0.7, 0.9, 2.0, 5.1), ("h", "hard", "ok", 0.6, 0.5, 1.0, 1.6)])
    found = {(r.id, r.rule) for r in evaluation.findings(evaluation.deltas(base, worse), params_changed=False).collect()}
    assert found == {("e", "boundary_f1_20ms drop"), ("e", "switches_per_min increase"), ("h", "suspicious improvement"), (None, "UNEXPLAINED")}
    assert evaluation.changed_params({"a": 1, "b": 2}, {"a": 1, "b": 3, "c": 4}) == {"b": (2, 3), "c": (None, 4)}
    assert {r.tier: r.n for r in evaluation.by_tier(base).collect()} == {"easy": 2, "hard": 1, None: 3}


def test_tracks(spark):
    frames = spark.createDataFrame([(1, "vad", 0, 0, 0.5, None), (1, "vad", 1, 0, float("nan"), 2.0), (1, "energy_rms", 0, 0, 7.0, None), (1, "energy_smooth", 0, 0, 6.0, None)], "rec long, track string, frame long, k int, value double, confidence double")
    dims = spark.createDataFrame([(1, "vad", "probability", 0.01, 3), (1, "energy_rms", "score", 0.02, None), (1, "none", "odd", 0.01, None)], "rec long, track string, semantics string, hop_s double, n_frames long")
    got = {(r.track, r.problem) for r in tracks.violations(frames, dims).collect()}
    assert {("vad", "not_finite"), ("vad", "confidence_range"), ("vad", "length"), ("none", "empty"), ("none", "semantics_unknown"), ("vad", "hop_mixed")} <= got
    assert {r.name: r.value for r in tracks.by_alias(frames).where("frame = 0").collect()} == {"vad": 0.5, "energy": 6.0}
    merged = tracks.merge_bundles(frames, frames.where("track = 'vad' and frame = 0"))
    assert merged.count() == 3


def test_pieces_of_a_long_segment_are_counted_from_its_start():
    """Adding 10 s step by step drifts from start + 10 * j, which decides windows on the edge of a limit."""
    step = lambda start: list(itertools.accumulate([10.0] * 25, initial=start))
    start = next(s / 100 for s in range(1, 10_000) if step(s / 100)[-1] != s / 100 + 250.0)
    assert [a for a, _, _ in chunking.units([(start, start + 260.0)])] == [start + 10.0 * j for j in range(26)]
