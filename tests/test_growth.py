"""Plans whose tasks must not grow with their input: one pass over it, parts by its size, no sort or table of all frames."""

import numpy as np
import pytest

from voxframe.operators import fusion, metrics, segments, spread, tracks
from voxframe.plans import catalogue


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["evaluate_paths", "evaluate_by_tier"])
def test_paths_are_decoded_and_scored_in_one_pass(spark, sf_dir, name):
    text = plan(catalogue.QUERIES[name](spark, sf_dir))
    assert text.count("FileScan") == 1 and text.count("MapInArrow") == 2 and "Join" not in text


def test_scores_agree_with_each_metric_alone(spark):
    rng = np.random.default_rng(3)
    names = np.array(["SIL", "A", "B", "OVL", "LEAK", None], dtype=object)
    path = lambda rec, n, step=1: [(rec, i * step, names[k]) for i, k in enumerate(np.repeat(rng.choice(6, n // 2, p=[0.2, 0.3, 0.3, 0.1, 0.05, 0.05]), 2))]
    table = lambda rows: spark.createDataFrame(rows, "rec long, frame long, state string")
    # 1 and 2: paths of other lengths; 3: without reference; 4: another grid; 5: a reference alone; no recording
    ref = table(path(1, 80) + path(2, 60) + path(4, 40, 2) + path(5, 10) + path(None, 10))
    hyp = table(path(1, 60) + path(2, 90) + path(3, 50) + path(4, 40) + path(None, 10))
    got = {r.rec: r for r in metrics.scores(ref, hyp, segments.ipus(hyp, 0.03)).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    least = {1: 60, 2: 60, 3: 50, 4: 40}
    cut = lambda d, k, step=1: d.where(f"rec = {k} and frame < {least[k] * step}")
    for k in least:
        h, r = cut(hyp, k), cut(hyp, k) if k == 3 else cut(ref, k, 2 if k == 4 else 1)
        want = metrics.framewise(r, h).first().asDict()
        for ms in (20, 50):
            want[f"boundary_f1_{ms}ms"] = metrics.boundary_scores(segments.boundaries(r), segments.boundaries(h), ms / 1000, h.select("rec")).first().f1
        total = spark.createDataFrame([(k, least[k] * 0.01)], "rec long, total_s double")
        want |= metrics.micro_ipus(segments.ipus(hyp.where(f"rec = {k}"), 0.03), total).first().asDict() | metrics.speaker_switches(h).first().asDict()
        want["rapid_alternations"] = metrics.rapid_alternations(h).first().rapid_alternations
        assert {c: got[k][c] for c in want} == pytest.approx(want)
        one = metrics.path_scores(metrics.side_by_side(r.selectExpr("rec", "0 as path", "frame", "state").unionByName(hyp.where(f"rec = {k}").selectExpr("rec", "1 as path", "frame", "state"))), least_s=0.03).first()
        assert one.micro_ipus_per_min == pytest.approx(want["micro_ipus_per_min"])


def test_distinct_frames_are_counted_without_a_table_of_them(spark):
    rows = [(1, "a", f) for f in (0, 0, 1, 63, 64, 200, -1, -64, None)] + [(1, "b", None), (2, "a", 0), (2, "a", 1)]
    t = spark.createDataFrame(rows, "rec long, track string, frame long")
    out = fusion.incomplete(t)
    assert [tuple(r) for r in out.collect()] == [(1, 0, 7, 200)] and "distinct" not in plan(out)


def test_frames_are_summed_before_they_meet_their_tracks(spark):
    frames = spark.createDataFrame([(1, "a", f, v, 1.0) for f, v in ((0, 0.5), (1, 2.0), (1, float("nan")), (70, 0.1))] + [(1, "s", 0, 9.0, 2.0)], "rec long, track string, frame long, value double, confidence double")
    dims = spark.createDataFrame([(1, "a", "probability", 0.01, 5), (1, "s", "score", 0.01, 1), (2, "a", "probability", 0.01, None)], "rec long, track string, semantics string, hop_s double, n_frames long")
    out = tracks.violations(frames, dims)
    assert sorted(map(tuple, out.collect())) == [(1, "a", "length", 2), (1, "a", "not_finite", 1), (1, "a", "probability_range", 2), (1, "s", "confidence_range", 1), (2, "a", "empty", 1)]
    assert "distinct" not in plan(out)


def test_blocks_of_all_tracks_are_not_sorted(spark, sf_dir):
    assert "SortAggregate" not in plan(catalogue.QUERIES["resample_all_tracks"](spark, sf_dir))


def test_bundles_merge_without_sorting_their_frames(spark, sf_dir):
    assert "SortMergeJoin" not in plan(catalogue.QUERIES["bundle_merge"](spark, sf_dir))
    t = spark.createDataFrame([(1, "a"), (1, None), (None, "a"), (2, "b")], "rec long, track string")
    merged = tracks.merge_bundles(t, t.where("track = 'a'")).collect()
    assert sorted(map(str, map(tuple, merged))) == sorted(map(str, [(1, "a"), (None, "a"), (1, None), (None, "a"), (2, "b")]))


@pytest.mark.parametrize("name", ["canonical_down", "downsample_max", "downsample_mean"])
def test_frames_take_one_sort(spark, sf_dir, name):
    assert plan(catalogue.QUERIES[name](spark, sf_dir)).count(" Sort [") == 1


def test_parts_follow_the_size_of_the_input(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    size = spread.input_bytes(items)
    assert spread.spread(items, "l_suppkey", part_bytes=size // 50).rdd.getNumPartitions() in (50, 51)
    assert spread.spread(items, "l_suppkey") is items


@pytest.mark.parametrize(("size", "parts"), [(3_000_000, 1), (30_000_000, 5), (1_200_000_000, 200), (3_900_000_000, 200), (4_100_000_000, 684)])
def test_parts_stay_few_enough_to_be_written_unsorted(spark, monkeypatch, size, parts):
    """Over 200 parts a task holds the rows of its whole split as it writes them."""
    monkeypatch.setattr(spread, "input_bytes", lambda rows: size)
    rows = spark.range(5, numPartitions=1)
    assert spread.spread(rows, "id").rdd.getNumPartitions() == parts


@pytest.mark.parametrize("name", ["downsample_max", "evaluate_by_tier"])
def test_frames_are_dealt_by_size_with_the_same_results(spark, sf_dir, monkeypatch, name):
    query = lambda: catalogue.QUERIES[name](spark, sf_dir)
    assert "REPARTITION_BY_NUM" not in plan(query())
    want = sorted(map(str, query().collect()))
    size = spread.input_bytes(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    monkeypatch.setitem(spread.spread.__kwdefaults__, "part_bytes", size // 7)
    assert "REPARTITION_BY_NUM" in plan(query())
    assert sorted(map(str, query().collect())) == want


def test_turns_are_dealt_by_their_number(spark, tmp_path):
    """20,000 short turns of one text, which make a small file."""
    spark.range(20_000).selectExpr("id div 5 as conv_id", "cast(id % 5 as int) as turn", "'user' as role", "'a b' as text").write.parquet(f"{tmp_path}/conversations.parquet")
    assert "REPARTITION_BY_NUM" in plan(catalogue.QUERIES["word_dedupe"](spark, str(tmp_path)))
    assert catalogue.QUERIES["word_dedupe"](spark, str(tmp_path)).count() == 2 * 20_000  # the doubled ones are repeats
